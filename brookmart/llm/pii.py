"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by patterns: e-mail addresses, phone numbers, payment cards, bank
accounts, social security numbers, IP addresses, secrets, and names behind a title. Every
distinct entity gets one surrogate for the whole table (coreference), drawn by a keyed
hash and of the same type: digits stay digits and keep their separators, phones keep their
country code, cards keep a valid check digit if they had one, secrets keep their letter
kinds and length, names keep script, number of words and the gender their titles show.

Surrogates are checked for collisions: one that another entity has drawn, or that equals an
entity of the table, is drawn again with the next counter, so distinct entities stay
distinct. The check runs on the distinct entities, in a fixed number of rounds; what still
collides after them (it needs a nearly used-up space) stops the job rather than mix people.

Mentions of the same entity in other formats or letter case share the surrogate and keep
their own format. Text outside entities is unchanged. Null texts stay null. Equal texts
and repeated rows get equal results. Other columns are carried along; the names that
begin with ``__pii`` are taken.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.llm.common import let, written

KEY = "surrogate-key-1"
ROUNDS = 4

FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
OTHER_TITLES = ["Dr", "Prof"]

_TITLE = "(?:" + "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=lambda t: (-len(t), t))) + r")\.?"
_SECRET_NAME = "(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)"
_ASSIGNED = rf"{_SECRET_NAME}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
_GROUPED_CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![ -]?[0-9])"
#: Where another entity begins, groups of digits do not go on.
_OTHER = rf"(?!(?<![A-Za-z0-9])(?:{_EMAIL}|(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{{32,}}(?![A-Za-z0-9]))|{_NATIONAL}|{_SSN}|{_IP})"
_OTHER_OR_CARD = rf"{_OTHER}(?!{_GROUPED_CARD})"
_GROUP = rf"{_OTHER_OR_CARD}[0-9]{{2,8}}"
#: Behind +1 ten digits; elsewhere 7 to 15 in all, with one kind of separator from the third group behind the code on.
_INTERNATIONAL = (
    r"(?<![0-9+])\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|[0-9]{{1,3}}[ .-]?\(?{_OTHER_OR_CARD}[0-9]{{2,4}}\)?[ .-]?{_GROUP}(?:(?<between>[ .-]?){_GROUP}(?:\k<between>{_GROUP}){{0,2}})?(?![0-9])"
    r"(?<=" + "|".join(r"\+" + r"[ .()-]{0,2}[0-9]" * n for n in range(7, 16)) + "))"
)
PATTERNS = [
    _EMAIL,
    rf"{_ASSIGNED}[A-Za-z0-9+/_.~-]{{8,}}={{0,2}}",
    r"(?<![A-Za-z0-9])(?i:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[a-f]*[0-9])[0-9a-f]{32,})(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?@[A-Z0-9]{4}){3,7}(?: ?@[A-Z0-9]{1,3})?(?![A-Za-z0-9])".replace("@", _OTHER),
    _INTERNATIONAL,
    r"(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    _NATIONAL,
    _SSN,
    _IP,
    rf"(?<![0-9])[0-9](?:[ -]?{_OTHER}[0-9]){{12,18}}(?![0-9])",
    rf"(?<![\p{{L}}\p{{N}}]){_TITLE} \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}",
]
ENTITY = "(?:" + "|".join(PATTERNS) + ")"
#: Every entity without a digit or @ holds one of these or follows it; secrets in any letter case.
SECRET_HINTS = ["token", "secret", "passw", "pwd", "key", "akia", "sk-", "gho_", "ghp_", "ghs_", "ghu_"]
NAME_HINTS = [*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES]
_HEX_KEY = r"[0-9a-fA-F]{32,}"


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def kind_of(raw: Column) -> Column:
    """Type of an entity as found."""
    return (
        F.when(raw.rlike(rf"\A{_ASSIGNED}"), "secret")
        .when(raw.contains("@"), "email")
        .when(raw.rlike(rf"\A{_TITLE} "), "name")
        .when(raw.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"), "ip")
        .when(raw.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn")
        .when(raw.rlike(r"\A(?:\+|\(|[0-9]{3}-[0-9]{3}-[0-9]{4}\z)"), "phone")
        .when(raw.rlike(rf"\A{_HEX_KEY}\z"), "secret")
        .when(raw.rlike(r"\A[A-Z]{2}[0-9]{2}[ A-Z0-9]+\z") & (F.length(raw) >= 16), "iban")
        .when(raw.rlike(r"\A[0-9](?:[ -]?[0-9]){12,18}\z"), "card")
        .otherwise("secret")
    )


def key_of(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    value = F.regexp_replace(raw, rf"\A{_ASSIGNED}", "")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "name", F.lower(F.regexp_replace(raw, rf"\A{_TITLE} ", "")))
        .when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.upper(F.regexp_replace(raw, " ", "")))
        .when(kind == "secret", F.when(value.rlike(rf"\A{_HEX_KEY}\z"), F.lower(value)).otherwise(value))
        .otherwise(raw)
    )


def gender_of(raw: Column) -> Column:
    def titled(titles: list[str]) -> Column:
        return raw.rlike(r"\A(?:" + "|".join(titles) + r")\.? ")

    return F.when(titled(FEMALE_TITLES), "f").when(titled(MALE_TITLES), "m")


def luhn(digits: Column) -> Column:
    """Check sum of a digit string modulo ten; 0 for a valid card."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(_letters(F.reverse(digits)), term), F.lit(0), lambda a, x: a + x) % 10


def _stream(secret: str, kind: Column, key: Column, attempt: Column, label: str = "") -> Column:
    """Hexadecimal digits drawn for an entity, as many as it has letters (64 at least)."""
    block = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(secret + label), kind, key, attempt.cast("string"), i.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(key) / 64).cast("int")), block), "")


_HEX = "0123456789abcdef"


def _shaped(key: Column, drawn: Column) -> Column:
    """Letter by letter a digit, small or capital letter like that of the key; the rest as it is."""
    digits, small = F.translate(drawn, "abcdef", "271828"), F.translate(drawn, _HEX, "bcdfghjkmnpqrstv")

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), F.substring(digits, i + 1, 1)).when(c.rlike("[a-z]"), F.substring(small, i + 1, 1))
            .when(c.rlike("[A-Z]"), F.upper(F.substring(small, i + 1, 1))).otherwise(c)
        )

    return F.array_join(F.transform(_letters(key), one), "")


_LATIN = (["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "st"], ["a", "e", "i", "o"])
_CYRILLIC = (["б", "д", "ф", "г", "к", "л", "м", "н", "п", "р", "с", "т", "в", "з", "бр", "ст"], ["а", "е", "и", "о"])
_GREEK = (["β", "δ", "φ", "γ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "χ", "ζ", "βρ", "στ"], ["α", "ε", "ι", "ο"])


def _name(secret: str, key: Column, gender: Column, attempt: Column) -> Column:
    """A name of as many words in the same script; the first of several words shows the gender."""
    def word(w: Column, i: Column, last: Column) -> Column:
        # Words are drawn one by one, so a family name alone and in full stays the same.
        drawn = F.sha2(F.concat_ws("\x1f", F.lit(secret), w, attempt.cast("string")), 256)

        def built(script: tuple[list[str], list[str]], ends: tuple[str, str]) -> Column:
            def syllable(n: int) -> Column:
                at = F.conv(F.substring(drawn, 2 * n + 1, 2), 16, 10).cast("int")
                return F.concat(F.get(F.array(*map(F.lit, script[0])), at % 16), F.get(F.array(*map(F.lit, script[1])), F.floor(at / 16).cast("int") % 4))

            first = (i == 0) & (last > 0)
            end = F.when(first & (gender == "f"), ends[0]).when(first & (gender == "m"), ends[1]).otherwise("")
            return F.initcap(F.concat(*[syllable(n) for n in range(4)], end))

        return F.when(w.rlike(r"\p{IsCyrillic}"), built(_CYRILLIC, ("на", "н"))).when(w.rlike(r"\p{IsGreek}"), built(_GREEK, ("να", "ς"))).otherwise(built(_LATIN, ("na", "n")))

    return let(F.split(key, "[ -]"), lambda ws: F.array_join(F.transform(ws, lambda w, i: word(w, i, F.size(ws) - 1)), " "))


def drawn(kind: Column, key: Column, gender: Column, attempt: Column, secret: str) -> Column:
    """Surrogate of an entity at the given attempt, in its common form."""
    stream = _stream(secret, kind, key, attempt)
    digits = F.translate(stream, "abcdef", "271828")
    size = F.length(key)
    octet = lambda n, low, span: (F.conv(F.substring(stream, 4 * n + 1, 4), 16, 10).cast("int") % span + low).cast("string")
    shaped = _shaped(key, stream)

    def card(d: Column) -> Column:
        body = F.substring(d, F.lit(1), size - 1)
        check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
        return F.concat(body, F.when(luhn(key) == 0, check).otherwise((check + 1 + F.substring(d, size, F.lit(1)).cast("int") % 9) % 10).cast("string"))

    return (
        F.when(kind == "email", F.concat(_shaped(F.substring_index(key, "@", 1), stream), F.lit("@mail"), F.right(digits, F.lit(6)), F.lit(".example.net")))
        .when(kind == "name", _name(secret, key, gender, attempt))
        .when(kind == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
        .when(kind == "card", card(F.substring(digits, F.lit(1), size)))
        .when(kind == "phone", F.concat(F.translate(F.substring(digits, 1, 1), "01", "57"), F.substring(digits, F.lit(2), size - 1)))
        .when(kind == "ssn", F.substring(digits, F.lit(1), size))
        .when(kind == "iban", F.concat(F.substring(key, 1, 2), F.substring(shaped, F.lit(3), size)))
        .otherwise(F.when(key.rlike(r"\A[0-9a-f]+\z"), F.substring(stream, F.lit(1), size)).otherwise(shaped))
    )


def shown(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention."""
    def filled() -> Column:
        # Digits are filled in from the right; a country code in front keeps its own.
        raw_digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
        start = F.struct(F.lit("").alias("s"), (F.length(surrogate) - raw_digits).alias("k"))

        def add(a: Column, c: Column) -> Column:
            digit = c.rlike("[0-9]")
            own = F.when(digit & (a["k"] >= 0), F.substring(surrogate, a["k"] + 1, F.lit(1))).otherwise(c)
            return F.struct(F.concat(a["s"], own).alias("s"), (a["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

        return F.aggregate(_letters(raw), start, add, lambda a: a["s"])

    capital_hex = raw.rlike(rf"\A(?:{_ASSIGNED})?(?=[0-9]*[A-F])[0-9A-F]{{32,}}\z")
    return (
        F.when(kind.isin("phone", "card", "ssn"), filled())
        .when(kind == "name", F.concat(F.regexp_extract(raw, rf"\A({_TITLE} )", 1), surrogate))
        .when(kind == "secret", F.concat(F.regexp_extract(raw, rf"\A((?:{_ASSIGNED})?)", 1), F.when(capital_hex, F.upper(surrogate)).otherwise(surrogate)))
        .when((kind == "iban") & raw.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 ")))
        .otherwise(surrogate)
    )


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__pii``: the entities of the text in order."""
    body = F.col(text)
    # A cheap test before the patterns.
    low = F.lower(body)
    hint = reduce(or_, [*(low.contains(h) for h in SECRET_HINTS), *(body.contains(h) for h in NAME_HINTS)], body.rlike("[0-9@]"))
    return docs.withColumn("__pii", F.when(hint, F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>")))


def surrogates(entities: DataFrame, secret: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """``kind``, ``key`` and ``surrogate``, distinct per kind, of a table with ``raw`` entities."""
    kind = kind_of(F.col("raw"))
    keyed = entities.select(kind.alias("kind"), key_of(kind, F.col("raw")).alias("key"), gender_of(F.col("raw")).alias("gender"))
    distinct = written(keyed.groupBy("kind", "key").agg(F.max("gender").alias("gender")), "pii-entities")
    taken = distinct.select("kind", F.col("key").alias("surrogate"))
    settled, open_ = None, distinct
    for attempt in range(rounds):
        draw = open_.withColumn("surrogate", drawn(F.col("kind"), F.col("key"), F.col("gender"), F.lit(attempt), secret))
        # The smallest key keeps a surrogate that several have drawn, unless an entity or an earlier one has it.
        before = taken if settled is None else taken.unionByName(settled.select("kind", "surrogate"))
        first = draw.groupBy("kind", "surrogate").agg(F.min("key").alias("key")).join(before, ["kind", "surrogate"], "left_anti")
        won = draw.join(first, ["kind", "surrogate", "key"], "left_semi").select("kind", "key", "surrogate")
        settled = written(won if settled is None else settled.unionByName(won), "pii-surrogates")
        open_ = distinct.join(settled, ["kind", "key"], "left_anti")
        if open_.isEmpty():
            return settled
    raise ValueError(f"surrogates still collide after {rounds} rounds: choose another key")


def replace(docs: DataFrame, text: str = "text", secret: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of entities as ``__pii_count``."""
    marked = found(docs, text)
    plain = marked.where((F.size("__pii") <= 0)).withColumn("__pii_count", F.lit(0).cast("long")).drop("__pii")
    body = F.col(text)
    holding = marked.where(F.size("__pii") > 0).withColumns({"__pii_a": F.xxhash64(body), "__pii_b": F.xxhash64(F.lit(1), body)})
    # One row per distinct text that holds entities; read twice, so it is stored.
    entities = written(holding.select("__pii_a", "__pii_b", "__pii").dropDuplicates(["__pii_a", "__pii_b"]), "pii-texts")
    each = entities.select("__pii_a", "__pii_b", F.posexplode("__pii").alias("at", "raw"))
    mapping = surrogates(each.select("raw"), secret)
    kind = kind_of(F.col("raw"))
    joined = each.withColumns({"kind": kind, "key": key_of(kind, F.col("raw"))}).join(mapping, ["kind", "key"])
    shown_at = joined.select("__pii_a", "__pii_b", F.struct("at", shown(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("s")).alias("x"))
    # One row per distinct text; its entities are a part of the text.
    listed = shown_at.groupBy("__pii_a", "__pii_b").agg(F.array_sort(F.collect_list("x")).alias("__pii_new"))
    rest = F.split(body, ENTITY, -1)
    new = let(rest, lambda r: F.concat(F.get(r, F.lit(0)), F.array_join(F.transform(F.col("__pii_new"), lambda x: F.concat(x["s"], F.get(r, x["at"] + 1))), "")))
    changed = holding.join(listed, ["__pii_a", "__pii_b"]).withColumn("__pii_count", F.size("__pii").cast("long")).withColumn(text, new)
    return plain.unionByName(changed.select(*plain.columns))
