"""PII surrogates: detected entities get keyed replacements of their own kind and form.

Entities are e-mail and IP addresses (versions 4 and 6), phone, card and social security
numbers, IBANs, long hexadecimal secrets, access keys and passwords, and names of people: after
a title, with a listed first name, after words that announce a name, or before a Chinese form
of address. The replacement of an entity follows from a secret key (HMAC-SHA-512) and its
canonical form (digits of a number, lower case of an address or name), so that every mention of
it, however written, gets the same one in its own writing: separators, case and length stay,
card numbers and IBANs keep valid check digits, letters their script, names their gender and
script. Replacements are checked over the whole corpus: one that two entities share, or that
occurs as an entity itself, is drawn anew, and after some draws in a wider form, so that the
forms never run out. A text is searched once, by a pattern of those kinds whose hints it has:
the matches are set between marks, one place for each kind, and the parts between the marks
are what the new text is woven from. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from itertools import groupby, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusvec.llm.shared import column, drop, own_name, spread_join, stored

# Titles by gender; first names by script and gender (n: either), for Chinese given names; surnames; forms of address.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Señor", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
FIRST = {
    ("latin", "m"): (
        "James", "Robert", "Michael", "David", "Thomas", "Daniel", "Paul", "Martin", "Stefan", "Carlos", "Pierre", "Miguel", "John", "William", "Richard", "Joseph", "Charles", "Christopher", "Matthew", "Anthony", "Steven", "Andrew",
        "Kevin", "Brian", "George", "Edward", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "José", "Juan", "Luis", "Javier", "Jean", "François", "Giovanni", "Marco", "Mohammed", "Ahmed", "Ali", "Raj", "Hiroshi", "Kenji", "Ming",
    ),
    ("latin", "f"): (
        "Mary", "Linda", "Susan", "Karen", "Laura", "Julia", "Sophie", "Claudia", "Carmen", "Helena", "Nicole", "Monique", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Jessica", "Sarah", "Lisa", "Nancy", "Sandra", "Ashley",
        "Emily", "Anna", "Alice", "Emma", "Petra", "Sabine", "Ursula", "Heike", "María", "Ana", "Lucía", "Isabel", "Marie", "Camille", "Giulia", "Francesca", "Fatima", "Aisha", "Priya", "Yuki", "Sakura", "Ling",
    ),
    ("latin", "n"): ("Alex", "Robin", "Sam", "Kim", "Jordan", "Taylor", "Casey", "Morgan", "Wei", "Andrea"),
    ("cyrillic", "m"): ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Мария", "Елена", "Ольга", "Наталья", "Ирина", "Светлана", "Татьяна", "Галина"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Шура"),
    ("han", "m"): ("伟", "强", "磊", "军", "杰", "涛", "明", "超"),
    ("han", "f"): ("芳", "娜", "静", "敏", "丽", "艳", "霞", "玲"),
    ("han", "n"): ("文", "华", "平", "林", "宁", "瑞", "安", "海"),
}
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
ADDRESSES = {"m": ("先生",), "f": ("女士", "小姐")}
# What announces a name.
CUES = ("My name is ", "my name is ", "Name: ", "name: ", "Signed, ", "Sincerely, ", "Regards, ", "regards, ", "Attn: ", "Contact: ", "Author: ", "author: ", "Dear ")
_SYLLABLES = {
    "latin": ("ba", "del", "mor", "ken", "lin", "ros", "tan", "vel", "wes", "har", "sto", "fer", "gal", "nor", "pel", "zan"),
    "cyrillic": ("ба", "дел", "мор", "кен", "лин", "рос", "тан", "вел", "вес", "хар", "сто", "фер", "гал", "нор", "пел", "зан"),
    "han": tuple(SURNAMES[:16]),
}
# The letters that letters of a script are replaced by; those of other scripts become Latin ones.
ALPHABETS = {r"\p{IsCyrillic}": "абвгдежзийклмнопрстуфхцчшщъыьэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsHan}": "安北川东方光海河江京林明南平山石天田西新阳永元月云中州子", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}


def _any(words: tuple[str, ...]) -> str:
    """One of the words, tried by their first letter."""
    return "(?:" + "|".join(a + "(?:" + "|".join(w[1:] for w in ws) + ")" for a, ws in groupby(sorted(words, key=lambda w: (w[0], -len(w), w)), key=lambda w: w[0])) + ")"


_NAMES = tuple(n for (script, _), ns in FIRST.items() if script != "han" for n in ns)
_TITLES = tuple(t for ts in TITLES.values() for t in ts)
_ADDRESS = "(?:" + "|".join(a for x in ADDRESSES.values() for a in x) + ")"
_CAP = r"\p{Lu}(?:\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?|['’]\p{Lu}\p{Ll}+)"
_CUED = "(?<=" + "|".join(CUES) + rf"){_CAP} {_CAP}(?: {_CAP})?"
_HEX = "[0-9A-Fa-f]{1,4}"
# Patterns of the kinds, the first that fits holds. A look at the first character comes first, as it is cheap.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,255}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"(?=\d)(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{N}]|\.\d)",
    "phone": r"(?=[\d+(])(?<![\p{L}\p{N}])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\p{L}\p{N}])",
    "ssn": r"(?=\d)(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?=\d)(?<![\p{L}\p{N}])(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{13,19})(?![\p{L}\p{N}])",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}}))(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?=[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11})(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?=[0-9a-fA-F])(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "key": r"(?=A)(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])|(?<=password=)[^\s\"']{6,64}+",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_any(_TITLES)}\.? {_CAP}(?: {_CAP})?|{_any(_NAMES)} {_CAP}|{_CUED})(?!\p{{L}})|[{SURNAMES}]\p{{IsHan}}{{0,2}}?{_ADDRESS}",
}
#: What a text needs for any entity of some kinds; a text is searched for those kinds alone whose hint it has.
HINTS = (
    (("email",), "@"),
    (("ip", "phone", "ssn", "card"), r"\d{3}|\d\.\d|\+\d"),
    (("ipv6", "iban", "secret", "key"), r"::|(?:[0-9A-Fa-f]{1,4}:){7}|[A-Z]{2}\d\d[ A-Z0-9]{11}|AKIA|password=|[0-9a-f]{32}|[0-9A-F]{32}"),
    (("person",), rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_any(_TITLES)}[. ]|{_any(_NAMES)} )|(?:{'|'.join(CUES)})\p{{Lu}}|{_ADDRESS}"),
)
# Marks around a match and between the places of kinds, noncharacters; texts that hold one are escaped by further ones.
_MARK, _PLACE = "\ufdd0", "\ufdd1"
_ESCAPES = (("\ufdd2", "\ufdd2\ufdd5"), (_MARK, "\ufdd2\ufdd3"), (_PLACE, "\ufdd2\ufdd4"))
#: Draws in an entity's own form; each later one is of a wider form.
DRAWS = 8


def _escaped(text: Column) -> Column:
    for char, escape in _ESCAPES:
        text = F.when(text.contains(char), F.replace(text, F.lit(char), F.lit(escape))).otherwise(text)
    return text


def _unescaped(text: Column) -> Column:
    out = text
    for char, escape in reversed(_ESCAPES):
        out = F.replace(out, F.lit(escape), F.lit(char))
    return F.when(text.contains(_ESCAPES[0][0]), out).otherwise(text)


def found(docs: DataFrame, text: str, parts: str) -> DataFrame:
    """docs with text cut at its entities: what stands between them at even places of parts, and at the odd ones each with _PLACE before it as often as its kind has others before it, and after it."""
    plain, flags = own_name(docs, "plain"), own_name(docs, "flags")
    has = [F.col(plain).contains(h) if len(h) == 1 else F.col(plain).rlike(h) for _, h in HINTS]
    flagged = docs.withColumn(plain, _escaped(column(text))).withColumn(flags, F.concat(*(h.cast("int").cast("string") for h in has)))
    marked = F.when(F.col(flags) == "0" * len(HINTS), F.col(plain))
    for on in product((False, True), repeat=len(HINTS)):
        kinds = [k for k in KINDS if any(take and k in ks for (ks, _), take in zip(HINTS, on, strict=True))]
        if kinds:
            places = (f"${kinds.index(k) + 1}" if k in kinds else "" for k in KINDS)
            search = F.regexp_replace(F.col(plain), F.lit("|".join(f"({KINDS[k]})" for k in kinds)), F.lit(_MARK + _PLACE.join(places) + _MARK))
            marked = marked.when(F.col(flags) == "".join("01"[take] for take in on), search)
    return flagged.withColumn(parts, F.split(marked, _MARK, -1)).drop(plain, flags)


def _kind(token: Column) -> Column:
    """Of a place of found(): the marks before the entity say its kind."""
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.length(F.regexp_extract(token, f"^{_PLACE}*", 0)) + 1)


def _without_title(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, rf"^{_any(_TITLES)}\.? ", ""), f"{_ADDRESS}$", "")


def _gender(token: Column) -> Column:
    """m, f or n of a name: its title's or form of address's, else its first name's."""
    first = _without_title(token)
    says = lambda g: token.rlike(rf"(?U)^{_any(TITLES[g])}\b|(?:{'|'.join(ADDRESSES[g])})$")
    listed = lambda g: first.rlike(rf"(?U)^{_any(FIRST['latin', g] + FIRST['cyrillic', g])}\b")
    return F.when(says("m"), "m").when(says("f"), "f").when(listed("m"), "m").when(listed("f"), "f").otherwise("n")


def _canon(kind: Column, token: Column) -> Column:
    name = F.concat(_gender(token), F.lit(":"), F.lower(_without_title(token)))
    return F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(token, r"\D", "")).when(kind.isin("ip", "key"), token).when(kind == "person", name).when(kind == "iban", F.replace(token, F.lit(" "))).otherwise(F.lower(token))


def _digest(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """128 hex digits: the HMAC-SHA-512 of entity and draw."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (bytes(b ^ mask for b in raw) for mask in (0x36, 0x5C))
    message = F.concat_ws("\n", kind, canon, draw.cast("string")).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 512))), 512)


def _nibble(digest: Column, i: Column) -> Column:
    """A byte of the digest, as a number, for place i."""
    return F.conv(F.substring(digest, (F.pmod(i * 2, F.lit(126)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string without its check digit."""
    back = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(F.element_at(F.when(i % 2 == 1, F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))).otherwise(F.array(*(F.lit(x) for x in range(10)))), back.substr(i, F.lit(1)).cast("int") + 1), F.lit(0)))


def _remainder97(body: Column) -> Column:
    """An IBAN's letters and digits, read as one number, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(body), F.lit(0), step)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities with a new surrogate where again is set; the digest is a column on the way, so that it is computed once a row."""
    digest = F.when(F.col("again"), _digest(key, F.col("kind"), F.col("canon"), F.col("draw")))
    new = F.when(F.col("digest").isNotNull(), _surrogate()).otherwise(F.col("surrogate"))
    return entities.withColumn("digest", digest).withColumn("surrogate", new).drop("digest", "again")


def _surrogate() -> Column:
    """The canonical replacement of columns kind, canon, draw and digest.

    From DRAWS draws on it has with each draw a digit, letter or syllable more, or octets above
    255; a password then has letters for its signs too. A password or address without letters
    and digits, which has no other of its own form, is widened from the first draw on.
    """
    kind, canon = F.col("kind"), F.col("canon")
    bare = ~F.when(kind == "email", F.regexp_replace(canon, r"\.[^.]+$", "")).when(kind == "key", canon).otherwise("0").rlike(r"[0-9\p{L}]")
    level = F.when(bare, F.col("draw") + 1).otherwise(F.greatest(F.col("draw") - (DRAWS - 1), F.lit(0)))
    h = F.col("digest")
    digit = lambda i: F.pmod(_nibble(h, i), F.lit(10)).cast("string")
    places = F.sequence(F.lit(0), F.greatest(F.length(canon), F.lit(1)) - 1 + level)
    number = F.array_join(F.transform(places, digit), "")
    # the country code of a phone number and the brand of a card stay
    kept = F.when(kind == "ssn", F.lit(0)).otherwise(F.lit(1))
    number = F.concat(F.substring(canon, F.lit(1), kept), F.substring(number, kept + 1, F.length(number)))
    body = F.expr("substring(canon, 1, length(canon) - 1)")
    check = lambda digits: F.pmod(F.lit(10) - F.pmod(_luhn_sum(digits), F.lit(10)), F.lit(10)).cast("string")
    valid = check(body) == F.expr("substring(canon, length(canon), 1)")
    drawn = F.substring(number, F.lit(1), F.length(canon) - 1 + level)
    # shorten first, as check() reads its argument more than once
    card = F.when(valid, F.concat(drawn, check(drawn))).otherwise(number)
    drawn_letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(_nibble(h, i), F.lit(26)) + 1, F.lit(1))

    def letter(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), digit(i))
        for script, letters in ALPHABETS.items():
            out = out.when(c.rlike(script), F.substring(F.lit(letters), F.pmod(_nibble(h, i), F.lit(len(letters))) + 1, F.lit(1)))
        return out.when((kind == "key") & (level > 0), drawn_letter(i)).otherwise(c)

    # from the far end of the digest, where short entities take nothing
    more = lambda n: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: drawn_letter(63 - i)), "")
    ending = F.regexp_extract(canon, r"(\.[^.]+)$", 1)
    front = F.expr("substring(canon, 1, length(canon) - length(regexp_extract(canon, '(\\\\.[^.]+)$', 1)))")
    email = F.concat(more(level), F.array_join(F.transform(_chars(front), letter), ""), ending)
    wide = F.concat_ws(".", *((F.pmod(_nibble(h, F.lit(2 * i)) * 256 + _nibble(h, F.lit(2 * i + 1)), F.lit(744)) + 256).cast("string") for i in range(4)))
    ip = F.when(level > 0, wide).otherwise(F.concat_ws(".", *((F.pmod(_nibble(h, F.lit(i)), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4))))
    prefix = F.when(canon.startswith("AKIA"), F.lit("akia")).otherwise(F.lit(""))
    other = F.concat(prefix, more(F.greatest(level - 1, F.lit(0))), F.array_join(F.transform(_chars(F.expr("substring(canon, 1 + if(startswith(canon, 'AKIA'), 4, 0))")), letter), ""))
    hexes = F.array_join(F.transform(places, lambda i: F.substring(h, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))), "")
    hex_at = lambda i: F.substring(h, F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))
    ipv6 = F.concat(F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(hex_at(i))), ""), F.array_join(F.transform(F.filter(F.sequence(F.lit(0), level), lambda i: i > 0), lambda i: hex_at(127 - i)), ""))
    account = F.transform(_chars(F.substring(canon, F.lit(5), F.length(canon))), lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).otherwise(F.upper(drawn_letter(i))))
    account = F.concat(F.array_join(account, ""), F.array_join(F.transform(F.filter(F.sequence(F.lit(0), level), lambda i: i > 0), lambda i: digit(63 - i)), ""))
    country = F.substring(canon, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((F.lit(98) - _remainder97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    script = F.when(canon.rlike(r"\p{IsHan}"), F.lit("han")).when(canon.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    own = lambda table, i: F.element_at(F.array(*(F.lit(x) for x in table)), F.pmod(_nibble(h, i), F.lit(len(table))) + 1)

    def by_script(test, pick) -> Column:
        """What pick makes of the table that test leaves for a script and gender."""
        out = None
        for (name, gender), table in FIRST.items():
            if test(name):
                fits = (script == name) & canon.startswith(gender + ":")
                out = F.when(fits, pick(table)) if out is None else out.when(fits, pick(table))
        return out

    first = by_script(lambda name: name != "han", lambda table: own(table, F.lit(0)))
    syllables = lambda name: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), level + 4), lambda i: own(_SYLLABLES[name], i)), ""))
    last = F.when(script == "latin", syllables("latin")).otherwise(syllables("cyrillic"))
    given = by_script(lambda name: name == "han", lambda table: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.length(canon) - 3 + level), lambda i: i > 0), lambda i: own(table, i)), ""))
    name = F.when(script == "han", F.concat(own(_SYLLABLES["han"], F.lit(0)), given)).when(canon.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)
    person = F.concat(F.substring(canon, F.lit(1), F.lit(2)), F.lower(name))
    return F.when(kind == "card", card).when(kind == "ipv6", ipv6).when(kind == "iban", iban).when(kind.isin("phone", "ssn"), number).when(kind == "ip", ip).when(kind == "secret", hexes).when(kind == "key", other).when(kind == "person", person).otherwise(email)


def _written(kind: Column, token: Column, surrogate: Column) -> Column:
    """The surrogate in the writing of the token: its separators, its case, its title."""
    # what a wider form has more goes behind the digits, and before letters
    def placed(at: str) -> Column:
        """The surrogate's characters one by one where the token has one that fits."""
        step = lambda a, c: F.when(c.rlike(at), F.struct(F.concat(a["out"], surrogate.substr(a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
        return F.aggregate(_chars(token), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda a: F.concat(a["out"], surrogate.substr(a["at"], F.length(surrogate))))

    more = F.greatest(F.length(surrogate) - F.length(token), F.lit(0))
    cased = F.concat(surrogate.substr(F.lit(1), more), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), lambda i: F.when(token.substr(i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(surrogate.substr(more + i, F.lit(1)))).otherwise(surrogate.substr(more + i, F.lit(1)))), ""))
    person = F.concat(F.regexp_extract(token, rf"^({_any(_TITLES)}\.? )", 1), F.initcap(F.substring(surrogate, F.lit(3), F.length(surrogate))), F.regexp_extract(token, f"({_ADDRESS})$", 1))
    ipv6 = F.when(token.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "ssn", "card"), placed("[0-9]")).when(kind == "iban", placed("[^ ]")).when(kind.isin("email", "secret", "key"), cased).when(kind == "person", person).when(kind == "ipv6", ipv6).otherwise(surrogate)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon), each once, other columns go along: plus surrogate, different for each and none of them an entity itself."""
    spark = entities.sparkSession
    # few bytes, but much work a row: dealt to all tasks, which Spark would join to few by their bytes
    dealt = entities.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "canon")
    first = dealt.select("*", F.lit(0).alias("draw"), F.lit(True).alias("again"), F.lit(None).cast("string").alias("surrogate"))
    now, path = stored(_drawn(first, key), "draw")
    while True:
        taken = now.select("kind", F.col("canon").alias("surrogate"), F.lit("").alias("canon"))
        # of those that share a replacement the first keeps it; one that is an entity goes to nobody
        owner = now.select("kind", "surrogate", "canon").unionByName(taken).groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        lost, lost_path = stored(now.join(owner.where("n > 1"), ["kind", "surrogate"]).where("canon <> owner").select("kind", "canon", F.lit(True).alias("again")), "lost")
        if lost.isEmpty():
            return now
        then = now.join(lost, ["kind", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce(F.col("again").cast("int"), F.lit(0)))
        after, after_path = stored(_drawn(then, key).select(*now.columns), "draw")
        drop(spark, path, lost_path)
        now, path = after, after_path


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with the entities replaced, n_entities.

    key is the secret that replacements follow from; who has it can rebuild them. A null text
    stays null and an empty one empty, with no entities; a text is searched whole, however long.
    Repeated rows get the same text each. A text without entities comes back unchanged. Other
    columns are not read; an empty table gives an empty one.
    """
    if not key:
        raise ValueError("a key is needed, or anyone could rebuild the replacements")
    own = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    rows, _ = stored(found(own.withColumn("row", F.monotonically_increasing_id()), "text", "parts").select("row", "doc_id", "parts"), "rows")
    some = F.size("parts") > 1  # null for a null text
    tokens = rows.where(some).select("row", F.posexplode("parts").alias("at", "place")).where(F.col("at") % 2 == 1).withColumn("kind", _kind(F.col("place")))
    tokens = tokens.withColumn("token", _unescaped(F.replace(F.col("place"), F.lit(_PLACE)))).withColumn("canon", _canon(F.col("kind"), F.col("token")))
    tokens, _ = stored(tokens.drop("place"), "tokens")
    mapping = surrogates(tokens.groupBy("kind", "canon").agg(F.count("*").alias("n")), key).select("kind", "canon", "surrogate", "n")
    put = spread_join(tokens, mapping, ["kind", "canon"], "n").select("row", "at", _written(F.col("kind"), F.col("token"), F.col("surrogate")).alias("new"))
    news = put.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda p: p["new"]).alias("new"))
    woven = F.array_join(F.transform("parts", lambda p, i: F.when(i % 2 == 1, F.get("new", F.floor(i / 2).cast("int"))).otherwise(_unescaped(p))), "")
    with_some = rows.where(some).join(news, "row").select("doc_id", woven.alias("text"), F.size("new").alias("n_entities"))
    return with_some.unionByName(rows.where(~F.coalesce(some, F.lit(False))).select("doc_id", _unescaped(F.col("parts")[0]).alias("text"), F.lit(0).alias("n_entities")))
