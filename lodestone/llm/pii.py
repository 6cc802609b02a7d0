"""Surrogates for personal data: keyed, type-consistent replacements that keep distinct things distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let
from ..operators.ranking import at_most, broadcast_if
from ..session import stored

# What is looked for. Order matters where two could begin at one place.
SECRET = (r"(?:(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"
          r"[^\s\"'<>&,;]{6,}|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b")
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)+[A-Za-z]{2,}+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
# Where a card may begin and end; the groupings of cards, of which at most one of each list fits at one place; any grouping.
CARD_START, CARD_END = r"(?<![\p{L}\d.])", r"(?![\p{L}\d])"
GROUPED = "|".join(r"\d{4}_\d{4}_\d{4}_\d{1,4}|\d{4}_\d{4}_\d{5}|\d{4}_\d{6}_\d{4,5}|\d{6}_\d{13}".replace("_", s) for s in " -")
LONGER = "|".join(r"\d{4}_\d{4}_\d{4}_\d{4}_\d{1,3}".replace("_", s) for s in " -")
FREE = r"\d(?:[ -]?\d){12,18}"
CARD = rf"{CARD_START}{FREE}{CARD_END}"
PHONE = r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\b\d{3}[.-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
TITLE_M = r"(?:Mr|Herr|Monsieur|Señor|Sr|Г-н|Господин)"
TITLE_F = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Г-жа|Госпожа)"
TITLE = rf"(?:{TITLE_M}|{TITLE_F}|Dr|Prof)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\.? \p{{Lu}}[\p{{L}}'’]+(?:[ -]\p{{Lu}}[\p{{L}}'’]+){{0,2}}"
# A text that nothing of this is found in holds no entity.
GATE = rf"[0-9@]|(?:(?i)password|passwd|pwd|token|secret|key)|(?<![\p{{L}}\p{{N}}]){TITLE}\.? \p{{Lu}}"
BEFORE_CARD = "|".join((SECRET, EMAIL, IBAN, IP, SSN, PHONE))

# Letters by script and case; a letter is replaced by one of its own row, one of no row by one of the first.
ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
]
FIRST_NAMES = {
    ("latin", "m"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marc", "Noah", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Petra"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "dan", "del", "fen", "gor", "hal", "ken", "lin", "mar", "nor", "pel", "ros", "sten", "tar", "vel"],
    "cyrillic": ["ба", "бер", "вал", "гор", "дан", "кор", "лин", "мар", "нов", "пет", "рос", "сам", "тар", "фил", "шев", "яр"],
}
# Letters of other scripts, and letters of the above with unusual marks, by property; each goes to its own script and case.
SCRIPTS = [
    (r"[\p{IsGreek}&&\p{Lu}]", ALPHABETS[5]), (r"\p{IsGreek}", ALPHABETS[4]), (r"[\p{IsCyrillic}&&\p{Lu}]", ALPHABETS[7]),
    (r"\p{IsCyrillic}", ALPHABETS[6]), (r"\p{IsHebrew}", ALPHABETS[8]), (r"\p{IsArabic}", ALPHABETS[9]),
    (r"\p{IsHan}", "".join(map(chr, range(0x4E00, 0x4F00)))), (r"\p{IsHangul}", "".join(map(chr, range(0xAC00, 0xD700, 28)))),
    (r"\p{IsHiragana}", "".join(map(chr, range(0x3042, 0x3094)))), (r"\p{IsKatakana}", "".join(map(chr, range(0x30A2, 0x30F4)))),
    (r"\p{IsDevanagari}", "".join(map(chr, range(0x0915, 0x093A)))), (r"\p{IsThai}", "".join(map(chr, range(0x0E01, 0x0E2F)))),
    (r"\p{Lu}", ALPHABETS[1]), (r"\p{L}", ALPHABETS[0]), (r"\p{N}", "0123456789"),
]
# Rounds of new surrogates for entities whose first one was taken; what is left then swaps among itself.
MAX_ROUNDS = 6
BROADCAST_EXCEPTIONS = 10_000
# Distinct entities of a task.
ENTITIES = 4_000


def _digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    base = F.concat_ws("\u001f", F.lit(key), kind, value, attempt.cast("string"))
    return let(base, lambda b: F.concat(*(F.sha2(F.concat_ws("\u001f", F.lit(str(n)), b), 512) for n in range(2))))


def _drawn(digest: Column, i: Column | int) -> Column:
    """Number below 65,536 from four digits of the digest at place ``i``."""
    at = ((F.lit(i) if isinstance(i, int) else i) % 63) * 4 + 1
    return F.conv(F.substr(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(digest: Column, i: Column | int, n: int) -> Column:
    return _drawn(digest, i) % n


def _each_char(text: Column, fn) -> Column:
    """``fn(character, place from 0)`` joined."""
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: fn(F.substr(text, i, F.lit(1)), i - 1)), "")


def _like(text: Column, digest: Column) -> Column:
    """Every digit and letter replaced within its own script and case, everything else kept."""
    def one(c: Column, n: Column) -> Column:
        take = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        out = F.when(F.lit("0123456789").contains(c), take("0123456789"))
        for letters in ALPHABETS:
            out = out.when(F.lit(letters).contains(c), take(letters))
        for script, letters in SCRIPTS:
            out = out.when(c.rlike(script), take(letters))
        return out.otherwise(c)

    return _each_char(text, lambda c, i: let(F.struct(c.alias("c"), _drawn(digest, i).alias("n")), lambda x: one(x["c"], x["n"])))


def _checksum(digits: Column) -> Column:
    """Luhn sum, modulo 10, of a string of digits."""
    n = F.char_length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        (n - i) % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int") * 2
    ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10


def _kind(found: Column) -> Column:
    whole = lambda pattern: found.rlike(f"^(?:{pattern})$")
    digits = F.regexp_replace(found, r"[^0-9]", "")
    return (
        F.when(whole(SECRET), "secret").when(whole(EMAIL), "email").when(whole(IP), "ip").when(whole(SSN), "ssn")
        .when(whole(PHONE), "phone").when(whole(CARD) & (_checksum(digits) == 0), "card")
        .when(whole(IBAN), "iban").otherwise("name")
    )


_LEAD = r"^((?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?|" + TITLE + r"\.? )?"


def _lead(found: Column, kind: Column) -> Column:
    """What stays before the value: the word that names a secret, the title of a person."""
    return F.when(kind.isin("secret", "name"), F.regexp_extract(found, _LEAD, 1)).otherwise("")


def _value(found: Column, kind: Column) -> Column:
    """The form in which all mentions of one thing agree."""
    rest = F.substr(found, F.char_length(_lead(found, kind)) + 1)
    return (
        F.when(kind == "email", F.lower(found)).when(kind.isin("card", "ssn", "iban"), F.regexp_replace(found, "[ -]", ""))
        .when(kind == "phone", F.regexp_replace(found, "[^0-9+]", ""))
        .when(kind == "name", F.lower(rest)).otherwise(rest)
    )


def _gender(found: Column) -> Column:
    return F.when(found.rlike(rf"^{TITLE_F}\b"), "f").when(found.rlike(rf"^{TITLE_M}\b"), "m").otherwise("u")


def _surname(value: Column, key: str, attempt: Column, script: str, gender: Column) -> Column:
    last = F.regexp_extract(value, r"([^ -]+)$", 1)
    digest = _digest(key, F.lit("surname"), last, attempt)
    letters = F.array(*map(F.lit, SYLLABLES[script]))
    parts = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(40)) + 2), lambda i: F.element_at(letters, _pick(digest, i, 16) + 1))
    name = F.initcap(F.array_join(parts, ""))
    return F.concat(name, F.when(gender == "f", "а").otherwise("")) if script == "cyrillic" else name


def _surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Replacement, in the form of ``value``; for a person of the ``gender`` f, m or u (not known)."""
    drawn = let(_digest(key, kind, value, attempt), lambda digest: F.struct(digest.alias("digest"), _like(value, digest).alias("liked")))
    return let(drawn, lambda x: _formed(kind, value, gender, attempt, key, x["digest"], x["liked"]))


def _formed(kind: Column, value: Column, gender: Column, attempt: Column, key: str, digest: Column, liked: Column) -> Column:
    extra = F.substr(digest, F.lit(200), (attempt * 2).cast("int"))
    domain = F.substring_index(value, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    place = F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(
        F.substring_index(liked, "@", 1), extra, F.lit("@mail"), F.conv(F.substr(place, F.lit(1), F.lit(6)), 16, 10), F.lit(".example."),
        F.when(ending.isin("com", "net", "org"), ending).otherwise("org"),
    )
    card = let(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(liked, F.lit(2), F.char_length(value) - 2)), lambda body: F.concat(
        body, ((10 - _checksum(F.concat(body, F.lit("0")))) % 10).cast("string")))
    octet = lambda i, low, n: (_pick(digest, i, n) + low).cast("string")
    octets = F.concat_ws(".", octet(1, 1, 254), octet(2, 1, 254), octet(3, 1, 254))
    ip = let(F.regexp_extract(value, r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1), lambda private: F.when(
        private == "", F.concat_ws(".", octet(0, 11, 100), octets)).when(
        private.contains("."), F.concat_ws(".", private, F.substring_index(octets, ".", 2))).otherwise(F.concat_ws(".", private, octets)))
    headed = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(liked, F.lit(3)))
    given = F.regexp_extract(value, r"^(.*)[ -][^ -]+$", 1)

    def person(script: str) -> Column:
        lists = {g: F.array(*map(F.lit, FIRST_NAMES[script, g])) for g in "mf"}
        n = len(FIRST_NAMES[script, "m"])

        def first(picked: Column) -> Column:
            female = (gender == "f") | ((gender == "u") & (_pick(picked, 5, 2) == 0))
            return F.element_at(F.when(female, lists["f"]).otherwise(lists["m"]), _pick(picked, 0, n) + 1)

        last = _surname(value, key, attempt, script, gender)
        named = let(F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit("given"), given), 512), first)
        return F.when(given == "", last).otherwise(F.concat_ws(" ", named, last))

    hexes = value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
    hexed = _each_char(value, lambda c, i: F.substr(F.lit("0123456789abcdef"), _pick(digest, i, 16) + 1, F.lit(1)))
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip)
        .when((kind == "iban") | ((kind == "phone") & value.startswith("+")), headed)
        .when(kind == "name", F.when(value.rlike(r"^[\p{IsLatin} '’-]+$"), person("latin")).when(
            value.rlike(r"^[\p{IsCyrillic} '’-]+$"), person("cyrillic")).otherwise(F.concat(F.initcap(liked), extra)))
        .when((kind == "secret") & hexes, F.when(F.upper(value) == value, F.upper(hexed)).otherwise(hexed)).otherwise(liked)
    )


def _shown(found: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: its separators, its case."""
    spaced = F.regexp_replace(found, r"[^0-9A-Za-z+]", "")
    laid = _each_char(found, lambda c, i: F.when(
        c.rlike("[0-9A-Za-z+]"),
        F.substr(surrogate, F.char_length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), r"[^0-9A-Za-z+]", "")), F.lit(1)),
    ).otherwise(c))
    upper = (F.upper(found) == found) & (F.lower(found) != found)
    rest = F.substr(found, F.char_length(_lead(found, kind)) + 1)
    loud = (kind == "name") & (F.upper(rest) == rest) & (F.char_length(rest) > 2)
    plain = F.when((kind == "email") & upper | loud, F.upper(surrogate)).otherwise(surrogate)
    grouped = kind.isin("card", "phone", "ssn", "iban") & (F.char_length(spaced) == F.char_length(surrogate))
    return F.concat(_lead(found, kind), F.when(grouped, laid).otherwise(plain))


def _cards(text: Column) -> Column:
    """The distinct numbers of a text that pass the checksum and may be cards, those to be preferred first.

    Candidates are read at every place where a number begins, also inside those that fail: plain runs and usual
    groupings, then any grouping that contains none of the former.
    """
    def valid(form: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"{CARD_START}(?=({form}){CARD_END})"), F.lit(1))
        return F.filter(F.array_distinct(found), lambda c: _checksum(F.regexp_replace(c, "[ -]", "")) == 0)

    def beside(first: Column, others: Column) -> Column:
        return F.concat(first, F.filter(others, lambda o: ~F.exists(first, lambda c: o.contains(c))))

    usual = let(valid(rf"\d{{13,19}}|{GROUPED}"), lambda a: beside(a, valid(LONGER)))
    return let(usual, lambda a: beside(a, valid(FREE)))


def _pattern(text: Column) -> Column:
    """Pattern of the entities of a text, with its valid cards word for word: what is no card is not consumed."""
    cards = F.when(text.rlike(CARD), _cards(text)).otherwise(F.array().cast("array<string>"))
    return let(cards, lambda c: F.when(F.size(c) > 0, F.concat(
        F.lit(f"{BEFORE_CARD}|{CARD_START}(?:"), F.array_join(c, "|"), F.lit(f"){CARD_END}|{NAME}")
    )).otherwise(F.lit(f"{BEFORE_CARD}|{NAME}")))


def mentions(text: Column, pattern: Column) -> Column:
    """array<struct<found, kind, value, gender>> of the entities of a text, in order; ``gender`` as the title tells it."""
    found = F.when(text.rlike(GATE), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda m: F.struct(m.alias("found"), _kind(m).alias("kind")))
    return F.transform(kinds, lambda m: F.struct(
        m["found"].alias("found"), m["kind"].alias("kind"), _value(m["found"], m["kind"]).alias("value"),
        F.when(m["kind"] == "name", _gender(m["found"])).otherwise("u").alias("gender")))


def _exceptions(entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, value, surrogate) of the entities whose surrogate is not the first one of their own mention; None if there are none.

    A surrogate is taken if it is the true value of any entity, if an earlier round gave it away, or if a smaller value
    gets it in the same round. All checks are joins and sums over the distinct entities, on the surrogate's own key.
    A person is given one gender: that of the titles that tell it. What finds no free surrogate, as its format has
    no more values than the texts, changes places with the others of that format that found none: none of them was given
    away before, so all stay distinct. One that is alone there is masked.
    """
    # A value without a letter or digit, such as a masked password, is its own surrogate.
    genders = entities.filter(F.col("value").rlike(r"[\p{L}\p{N}]")).groupBy("kind", "value").agg(
        F.min("gender").alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed"))
    everything = stored(genders, "pii-entities")
    n = everything.count()
    if not n:
        return None
    # Work goes by the number of entities, not by their bytes.
    waiting, settled, moved = everything.repartition(-(-n // ENTITIES), "value"), None, everything.limit(0).select(
        "kind", "value", F.lit("").alias("surrogate"))
    for attempt in range(MAX_ROUNDS):
        tried = stored(waiting.withColumn(
            "surrogate", _surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(attempt), key)), "pii-tried")
        mine = tried.withColumn("taken", F.lower("surrogate"))
        real = everything.select("kind", F.lower("value").alias("taken")).distinct().withColumn("by", F.lit(""))
        if settled is not None:
            real = real.union(settled.select("kind", F.lower("surrogate"), F.lit("")))
        claims = real.union(mine.select("kind", "taken", F.concat(F.lit("1"), F.col("value")))).groupBy("kind", "taken").agg(F.min("by").alias("winner"))
        decided = mine.join(claims, ["kind", "taken"]).withColumn("won", F.col("winner") == F.concat(F.lit("1"), F.col("value")))
        decided = stored(decided.select("kind", "value", "gender", "mixed", "surrogate", "won"), "pii-decided")
        won = decided.filter("won")
        settled = won if settled is None else settled.union(won)
        moved = moved.union((won if attempt else won.filter("mixed")).select("kind", "value", "surrogate"))
        waiting = decided.filter("not won").select("kind", "value", "gender", "mixed")
        if waiting.isEmpty():
            break
    else:
        form = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\p{N}", "0"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")
        network = F.when(F.col("kind") == "ip", F.regexp_extract("value", r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1)).otherwise(
            F.when(F.col("kind").isin("phone", "iban"), F.substr("value", F.lit(1), F.lit(2))).when(F.col("kind") == "card", F.substr("value", F.lit(1), F.lit(1))))
        ring = W.partitionBy("kind", "form").orderBy(F.sha2(F.concat_ws("\u001f", F.lit(key), "value"), 256))
        whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        placed = waiting.withColumn("form", F.when(F.col("kind") == "ip", network).otherwise(F.concat_ws("|", network, form)))
        following = F.coalesce(F.lead("value").over(ring), F.first("value").over(whole))
        masked = F.regexp_replace("value", r"[\p{L}\p{N}]", "*")
        moved = moved.union(placed.select("kind", "value", F.when(F.count("*").over(whole) > 1, following).otherwise(masked)))
    moved = stored(moved, "pii-moved")
    return None if moved.isEmpty() else moved


def surrogates(df: DataFrame, key: str, text: str, secret: str, found: str = "replaced") -> DataFrame:
    """``df`` with every detected entity in ``text`` replaced, and ``found``: array<struct<kind, surrogate>>, in order.

    Emails, telephone, card (by checksum), social security and account numbers, addresses of machines, secrets, and
    names after a title. A surrogate depends on ``secret`` and the entity alone: all mentions of one thing, in any
    document and format and with any title, get the same one, and different things get different ones, none of which is the
    true value of another, unless a format has no more values than the texts: there entities change places. It
    keeps kind, format, script and case, for persons the gender that a title tells, and checksums stay valid.
    A value without letters and digits, such as a masked password, stays. ``secret`` must be kept; without it
    surrogates cannot be recomputed.

    A null text stays null and an empty one empty, both with no entities; texts without entities are returned as they
    are. Rows are kept apart, also equal ones, and other columns stay, but one named ``found`` is replaced. Each text is
    rewritten in its own row. Only distinct entities are shuffled, for the collision check; the few that collide are
    joined back by entity.
    """
    body = F.col(text)
    any_of, exceptions, new, row_key = "_pii_any", "_pii_exceptions", "_pii_new", "_pii_key"
    while {any_of, exceptions, new, row_key} & {c.lower() for c in df.columns}:
        any_of, exceptions, new, row_key = (c + "_" for c in (any_of, exceptions, new, row_key))
    lists = df.withColumn(any_of, _pattern(body)).select(F.col(key).alias("k"), F.explode(mentions(body, F.col(any_of))).alias("m"))
    moved = _exceptions(lists.select("m.kind", "m.value", "m.gender").distinct(), secret)
    out = df.drop(found)
    if moved is None:
        out = out.withColumn(exceptions, F.lit(None).cast("map<string,string>"))
    else:
        hit = lists.select("k", "m.kind", "m.value").join(
            broadcast_if(moved, at_most(moved, BROADCAST_EXCEPTIONS)), ["kind", "value"]
        ).select("k", F.concat_ws("\u001f", "kind", "value").alias("thing"), "surrogate").distinct()
        by_row = stored(hit.groupBy(F.col("k").alias(row_key)).agg(
            F.map_from_entries(F.collect_list(F.struct("thing", "surrogate"))).alias(exceptions)), "pii-rows")
        small = at_most(by_row, BROADCAST_EXCEPTIONS)
        out = out.join(broadcast_if(by_row, small), F.col(key).eqNullSafe(F.col(row_key)), "left").drop(row_key)

    def replaced(m: Column) -> Column:
        other = F.element_at(F.col(exceptions), F.concat_ws("\u001f", m["kind"], m["value"]))
        value = F.when(~m["value"].rlike(r"[\p{L}\p{N}]"), m["value"]).otherwise(
            F.coalesce(other, _surrogate(m["kind"], m["value"], m["gender"], F.lit(0), secret)))
        return F.struct(m["kind"].alias("kind"), let(value, lambda v: _shown(m["found"], m["kind"], v)).alias("surrogate"))

    with_lists = out.withColumn(any_of, _pattern(body)).withColumn(new, F.transform(mentions(body, F.col(any_of)), replaced))
    between = F.split(body, F.col(any_of), -1)
    rewritten = F.when(F.size(new) > 0, F.array_join(F.zip_with(
        between, F.col(f"{new}.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(body)
    return with_lists.select(
        *((rewritten if c.lower() == text.lower() else F.col(f"`{c}`")).alias(c) for c in df.columns if c.lower() != found.lower()),
        F.coalesce(new, F.array().cast("array<struct<kind:string,surrogate:string>>")).alias(found),
    )
