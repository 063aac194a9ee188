"""Personal data replaced by surrogates (operator 2).

Detected entities (e-mail addresses, phone numbers, payment cards, bank account
numbers, IPv4 and IPv6 addresses, social security numbers, secrets, names after a form of address)
are replaced by invented ones of the same type:

* *Keyed.* A surrogate is derived from a SHA-512 of (key, type, attempt, canonical
  form), so it cannot be traced back without the key.
* *Consistent.* The canonical form drops case and separators; every mention of an
  entity, however written, in whatever document, gets the same surrogate, written in
  that mention's format (digits for digits, letters of the same script and
  case, the same separators). Cards keep their issuer and a valid check digit, account numbers their
  country and valid check digits, IP octets their length. Names are found behind a
  form of address; all further capitalised mentions of their words in that document count as mentions
  of the person. A name's stem follows from the name alone, its ending from the gender and place that all
  its mentions in the document settle (a form of address with a gender counts before one without). Initials get a letter each; there are
  too few for them to be distinct.
* *Distinct.* All entities of the corpus are checked: where two entities of a type would
  get one surrogate, or a surrogate equals another entity that really
  occurs, all but one take the next attempt, until there are no collisions; a round looks at the new
  surrogates only. Names and e-mail
  addresses get two more letters every four attempts, so their number is not limited. Few do; they are
  looked up by document, all others follow from the key alone.

Everything is DataFrame expressions: texts are scanned for the entity table
and once more for the replacement, where a text is split at its entities and put
together again with the surrogates; a document with names is split at their further
mentions too, by a pattern of its own. Texts are exchanged only if the
collisions are too many to be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, fits_broadcast, keyed, stored

MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "M\\.", "Monsieur", "Sr", "Señor", "Don", "Signor", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Mme", "Madame", "Mlle", "Mademoiselle", "Sra", "Srta", "Señora", "Señorita", "Doña", "Signora", "г-жа")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Capt", "Captain", "Colonel", "Lt", "Sgt", "Rev", "Reverend", "Senator")
#: Each pattern begins with what its first characters must be: that is cheaper than looking back at every place.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
_SECRET = r"(?=[0-9A-Fa-fgps])(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,64})(?![\p{L}\p{N}])"
_IBAN = r"(?=[A-Z]{2}\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_IP6 = (r"(?=[0-9A-Fa-f]{0,4}:)(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
        r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\p{L}\p{N}:])")
_IP = r"(?=\d{1,3}\.)(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\p{N})"
#: With spaces instead of hyphens only numbers that can have been given out.
_SSN = r"(?=\d{3}[- ])(?<![\p{N}-])(?:\d{3}-\d{2}-\d{4}(?![\p{N}-])|(?<!\p{N} )(?!000|666|9)\d{3} (?!00)\d{2} (?!0000)\d{4}(?! ?\p{N}))"
_CARD = r"(?=\d{4})(?<!\p{N})(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\p{N})"
_PHONE = (r"(?=[+(\d])(?<![\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
          r"|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\p{N} )[2-9]\d{2} [2-9]\d{2} \d{4}(?! \p{N}))(?!\p{N})")
#: Letters from a capital on, with apostrophes inside, but without a contracted word at the end (Smith's).
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?!(?i:s|d|ll|re|ve)(?!\p{L}))(?=\p{L}))++"
_NAME_PART = _NAME + r"|\p{Lu}"
_NAME_WORD = rf"(?:\p{{Lu}}\.-?)*+{_NAME}(?:-{_NAME})*+"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_FIRST_NAME = rf"(?:{_NAME_WORD}|{_INITIALS}|\p{{Lu}}(?![\p{{L}}\p{{M}}]))"
#: Lower-case words within a name; they stay.
_PARTICLES = r"(?:(?:de|la|las|los|del|della|di|da|do|dos|du|van|von|der|den|ter|zu|bin|ibn|al|el|le) ){0,3}"
_TITLE = "(?:" + "|".join((*FEMALE, *MALE, *NEUTRAL)) + ")"
_TITLES = rf"(?:{_TITLE}\.? ){{1,4}}"
_PERSON = rf"(?=[A-Zг])(?<!\p{{L}}){_TITLES}{_PARTICLES}{_FIRST_NAME}(?: (?:{_PARTICLES}{_NAME_WORD}|(?:{_INITIALS}|\p{{Lu}})(?= \p{{Lu}})))*+"
PATTERN = "|".join((_EMAIL, _IBAN, _SECRET, _IP6, _IP, _SSN, _CARD, _PHONE, _PERSON))
_ISSUERS = r"^(4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(011|5))"
#: (consonants, vowels, ends) of invented names.
LATIN = ("bdfgklmnprstvz", "aeiou", {"given_f": "na", "given_m": "nor", "given": "lin", "surname": "dson"})
CYRILLIC = ("бвгдзклмнпрст", "аеиоу", {"given_f": "на", "given_m": "слав", "given": "ль", "surname": "ов"})
GREEK = ("βγδκλμνπρστφ", "αεηιου", {"given_f": "να", "given_m": "νος", "given": "λιν", "surname": "ιδης"})
ARMENIAN = ("բգդզլկմնպստր", "աեիու", {"given_f": "նա", "given_m": "նոր", "given": "լին", "surname": "յան"})
#: Letters that take the place of a letter in an e-mail address, by script or block.
SCRIPTS = {
    "IsCyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω", "IsArmenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
    "IsGeorgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת", "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsDevanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "IsBengali": "কখগঘচছজঝটঠডঢণতথদধনপফবভমযরলশষসহ", "IsThai": "กขคงจชซญดตถทธนบปผพภมยรลวสหอ",
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "IsHangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후", "IsHan": "一二三四五六七八九十大小山川水火木金土日月田中上下左右東西南北春夏秋冬天地人心手文字明林森花草石雨雪風空海",
}
#: Lists of up to this many documents with colliding entities may be broadcast.
BROADCAST_ROWS = 500_000


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum: digits at even places from the right count double."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """A number of digits and capital letters (A = 10) modulo 97."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def entity_type(m: Column) -> Column:
    """The type of a match of ``PATTERN``, or null if it is only alike (an impossible octet, a wrong check digit)."""
    octets = F.split(m, r"\.")
    number = F.regexp_replace(m, r"[ -]", "")
    account = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(account, F.lit(5), F.char_length(account)), F.substring(account, 1, 4))
    groups = F.filter(F.split(m, ":"), lambda g: g != "")  # a::b may be anything
    telling = (F.size(F.split(m, ":")) <= 8) & ((F.size(groups) >= 3) | (F.size(groups) == 2) & F.exists(groups, lambda g: g.rlike("^(?=.*[0-9]).{4}$")))
    return (F.when(F.contains(m, F.lit("@")), "email")
            .when(m.rlike(f"^(?:{_IBAN})$"), F.when(_mod97(moved) == 1, "iban"))
            .when(F.contains(m, F.lit(":")) & ~m.rlike(r"\s"), F.when(m.rlike(r"^[0-9A-Fa-f:]+$") & telling, "ip6"))
            .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
            .when(m.rlike(r"^\d{3}([ -])\d{2}\1\d{4}$"), "ssn")
            .when(m.rlike(f"^(?:{_SECRET})$") & ~m.rlike(r"^\d+$"), "secret")
            .when(m.rlike(f"^(?:{_CARD})$"), F.when(number.rlike(_ISSUERS) & (_luhn(number) % 10 == 0), "card"))
            .when(m.rlike(r"^\p{L}"), "person")
            .otherwise("phone"))


def _full_name(m: Column) -> Column:
    """What follows the forms of address."""
    return F.regexp_replace(m, f"^{_TITLES}(?={_PARTICLES}{_FIRST_NAME})", "")


def _names(s: Column) -> Column:
    """The names and initials in a full name; parts with a hyphen between them count one by one."""
    return F.regexp_extract_all(s, F.lit(_NAME_PART), F.lit(0))


def _name_key(w: Column) -> Column:
    return F.translate(F.lower(w), "’", "'")


def units(m: Column) -> Column:
    """What gets a surrogate in a match: array of (type, canonical). A name's words count one by one."""
    kind = entity_type(m)
    titled = lambda titles: m.rlike(rf"^(?:{_TITLE}\.? ){{0,3}}(?:{'|'.join(titles)})\.? ")
    given = F.when(titled(FEMALE), "given_f").when(titled(MALE), "given_m").otherwise("given")
    once = F.array(F.struct(F.split(_full_name(m), " ").alias("words"), given.alias("given")))  # not anew for each word
    person = F.flatten(F.flatten(F.transform(once, lambda x: F.transform(x.words, lambda w, i: F.transform(_names(w), lambda p: F.struct(
        F.when(F.char_length(p) == 1, "initial").when(i < F.size(x.words) - 1, x.given).otherwise("surname").alias("type"),
        _name_key(p).alias("canonical")))))))
    canonical = F.when(kind.isin("email", "secret", "ip6"), F.lower(m)).when(kind == "ip", m).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(_digits(m))
    none = F.array().cast("array<struct<type:string,canonical:string>>")
    return F.when(kind.isNull(), none).when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("type"), canonical.alias("canonical"))))


#: The types of a name's words, those that settle its ending first. For distinctness all are one type, ``NAME``.
NAME_TYPES, NAME = ("given_f", "given_m", "given", "surname"), "name"


def entity_of(kind: Column) -> Column:
    """The type under which an entity is kept distinct."""
    return F.when(kind.isin(*NAME_TYPES), NAME).otherwise(kind)


def _by_script(canonical: Column, of) -> Column:
    """``of`` the letters and endings of a name's script (other scripts: Latin)."""
    return (F.when(canonical.rlike(r"^\p{IsLatin}"), of(LATIN)).when(canonical.rlike(r"^\p{IsCyrillic}"), of(CYRILLIC))
            .when(canonical.rlike(r"^\p{IsGreek}"), of(GREEK)).when(canonical.rlike(r"^\p{IsArmenian}"), of(ARMENIAN)).otherwise(of(LATIN)))


def ending(kind: Column, canonical: Column) -> Column:
    """The ending of an invented name of the type."""
    return _by_script(canonical, lambda script: F.element_at(F.create_map(*[F.lit(x) for k in NAME_TYPES for x in (k, script[2][k])]), kind))


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The surrogate's letters and digits in order (an IP address: as a whole; a name: its stem). ``kind``: as ``entity_of`` gives it."""

    def draw(i: Column | int, n: int) -> Column:  # a number below n (n up to 65,536) for place i
        i = F.lit(i) if isinstance(i, int) else i
        part = F.floor(i / 32).cast("string")  # 32 places a digest
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canonical, part).cast("binary"), 512)
        at = F.pmod(i, F.lit(32)) * 4 + 1
        return F.pmod(F.conv(F.substring(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int"), F.lit(n))

    def pick(letters: str, i: Column | int) -> Column:
        return F.substring(F.lit(letters), draw(i, len(letters)) + 1, F.lit(1))

    def join(a: Column) -> Column:
        return F.array_join(a, "")

    numbers = lambda first: join(F.transform(_chars(canonical), lambda c, i: F.when(i < first, c).otherwise(pick("0123456789", i))))
    keep = F.when(F.substring(canonical, 1, 1) == "4", 1).otherwise(4)
    body = F.substring(numbers(keep), F.lit(1), F.char_length(canonical) - 1)
    card = F.concat(body, F.pmod(F.lit(0) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    short = attempt < 20  # a short address has few others of its format: later attempts use all octets
    ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda o, i: (
        F.when(short & (F.char_length(o) == 1), draw(i, 10)).when(short & (F.char_length(o) == 2), draw(i, 90) + 10)
        .when(short, draw(i, 156) + 100).otherwise(draw(i, 256))).cast("string")), ".")
    hexes = join(F.transform(F.filter(_chars(canonical), lambda c: c.rlike(r"[\p{L}\p{N}]")),
                             lambda c, i: F.when(canonical.rlike("^[0-9a-f]+$"), pick("0123456789abcdef", i)).otherwise(pick("0123456789abcdefghijklmnopqrstuvwxyz", i))))

    def alike(c: Column, i: Column | int) -> Column:
        out = F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
        other = F.when(c.rlike(r"\p{IsLatin}"), pick("àáâäçèéêëíîïñóôöùúûü", i))
        for script, own in SCRIPTS.items():
            other = other.when(c.rlike(rf"\p{{{script}}}"), pick(own, i))
        return out.when(c.rlike(r"\p{L}"), other.otherwise(pick("àáâäçèéêëíîïñóôöùúûü", i))).otherwise(c)

    host_end = F.char_length(F.regexp_replace(F.element_at(F.split(canonical, r"\."), -1), r"[^\p{L}\p{N}]", ""))
    letters = F.filter(_chars(canonical), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    email = join(F.transform(letters, lambda c, i: F.when(i >= F.size(letters) - host_end, c).otherwise(alike(c, i))))
    more = 2 * F.floor(attempt / 4).cast("int")  # a small space is used up: each four attempts take longer forms
    longer = join(F.transform(F.sequence(F.lit(1), more), lambda i: pick("abcdefghijklmnopqrstuvwxyz", i + F.lit(1 << 20))))
    email = F.when(attempt >= 4, F.concat(longer, email)).otherwise(email)

    def stem(consonants: str, vowels: str, _: dict[str, str]) -> Column:
        first = F.concat(*[pick(consonants if i % 2 == 0 else vowels, i) for i in range(6)])
        grown = join(F.transform(F.sequence(F.lit(6), more + 5), lambda i: F.when(i % 2 == 0, pick(consonants, i)).otherwise(pick(vowels, i))))
        return F.when(attempt >= 4, F.concat(first, grown)).otherwise(first)

    hex_group = lambda i: F.concat(pick("123456789abcdef", i), *[pick("0123456789abcdef", i + k) for k in (1, 2, 3)])
    ip6 = join(F.transform(_chars(canonical), lambda c, i: F.when(c == ":", c).otherwise(pick("123456789abcdef", i))))
    ip6 = F.when(short, ip6).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(28), F.lit(4)), hex_group), ":"))
    body = F.substring(canonical, F.lit(5), F.char_length(canonical))
    account = join(F.transform(_chars(body), lambda c, i: F.when(c.rlike("[0-9]"), pick("0123456789", i)).otherwise(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))))
    country = F.substring(canonical, 1, 2)
    iban = F.element_at(F.transform(F.array(account), lambda a: F.concat(
        country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)), 1)
    return (F.when(kind == "initial", alike(canonical, 0)).when(kind == "email", email).when(kind == "secret", hexes).when(kind == "ip", ip).when(kind == "ip6", ip6)
            .when(kind == "iban", iban).when(kind == "card", card).when(kind == "ssn", numbers(0)).when(kind == "phone", numbers(1))
            .otherwise(_by_script(canonical, lambda script: stem(*script))))


def _written_like(mention: Column, letters: Column) -> Column:
    """``letters`` put in the places of the mention's letters and digits, with their case; what they have more comes first."""
    more = F.char_length(letters) - F.char_length(F.regexp_replace(F.lower(mention), r"[^\p{L}\p{N}]", ""))
    start = F.struct(F.lit("").alias("out"), F.greatest(more, F.lit(0)).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        own = F.substring(letters, acc.k + 1, F.lit(1))
        own = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(own)).otherwise(own)
        used = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc.out, F.when(used, own).otherwise(c)).alias("out"), (acc.k + used.cast("int")).alias("k"))

    loud = (mention == F.upper(mention)) & (mention != F.lower(mention))
    letters = F.when(loud, F.upper(letters)).otherwise(letters)
    return F.concat(F.substring(letters, F.lit(1), F.greatest(more, F.lit(0))), F.aggregate(_chars(mention), start, step, lambda acc: acc.out))


def _persons(matches: Column) -> Column:
    """The distinct names in a document's matches, in order: array of (type, canonical, written); no initials.

    A name has one type: the first of ``NAME_TYPES`` that some mention has.
    """
    named = F.filter(matches, lambda m: entity_type(m) == "person")
    words = F.flatten(F.transform(named, lambda m: F.zip_with(units(m), _names(_full_name(m)), lambda u, w: F.struct(
        u.type.alias("type"), u.canonical.alias("canonical"), w.alias("written")))))
    words = F.array_distinct(F.filter(words, lambda u: u.type != "initial"))
    of = lambda ws, k: F.transform(F.filter(ws, lambda u: u.type == k), lambda u: u.canonical).alias(k)
    once = F.transform(F.array(words), lambda ws: F.struct(ws.alias("words"), *[of(ws, k) for k in NAME_TYPES[:-1]]))  # not anew for each word

    def settled(x: Column, u: Column) -> Column:
        kind = F.lit(NAME_TYPES[-1])
        for k in reversed(NAME_TYPES[:-1]):
            kind = F.when(F.array_contains(x[k], u.canonical), k).otherwise(kind)
        return F.struct(kind.alias("type"), u.canonical.alias("canonical"), u.written.alias("written"))

    return F.array_distinct(F.flatten(F.transform(once, lambda x: F.transform(x.words, lambda u: settled(x, u)))))


def _pattern(names: Column) -> Column:
    """``PATTERN``, and as the last choice each whole word with a capital that is one of the names."""
    written = F.array_distinct(F.transform(names, lambda u: F.regexp_replace(F.lower(u.written), "['’]", "['’]")))
    # lower-casing may change a letter's length (İ): the name as it is written counts too
    forms = F.array_distinct(F.concat(written, F.transform(names, lambda u: F.regexp_replace(u.written, "['’]", "['’]"))))
    word = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(F.size(names) == 0, F.lit(PATTERN)).otherwise(word)


def _replaced(m: Column, attempts: Column, names: Column, key: str) -> Column:
    """The text that takes a match's place. ``attempts``: map from "type|canonical" to attempt; ``names``: of the document."""
    further = (entity_type(m) == "person") & ~F.contains(m, F.lit(" "))
    known = lambda c: F.element_at(F.filter(names, lambda u: u.canonical == c), 1)
    alone = F.transform(F.filter(F.array(_name_key(m)), lambda c: F.exists(names, lambda u: u.canonical == c)), lambda c: F.struct(F.lit(NAME).alias("type"), c.alias("canonical")))
    all_ = F.when(further, alone).otherwise(F.transform(units(m), lambda u: F.struct(entity_of(u.type).alias("type"), u.canonical.alias("canonical"))))

    def invented(u: Column) -> Column:
        s = surrogate(u.type, u.canonical, F.coalesce(F.element_at(attempts, F.concat_ws("|", u.type, u.canonical)), F.lit(0)), key)
        return F.struct(u.type.alias("type"), F.when(u.type == NAME, F.concat(s, ending(known(u.canonical).type, u.canonical))).otherwise(s).alias("s"))

    own = F.transform(all_, invented)

    def write(own: Column) -> Column:
        first = F.element_at(own, 1)
        name = _full_name(m)
        words = F.zip_with(_names(name), own, lambda w, u: F.when((w == F.upper(w)) & (F.char_length(w) > 1), F.upper(u.s)).otherwise(F.initcap(u.s)))
        between = F.split(name, _NAME_PART, -1)
        named = F.concat(F.substring(m, F.lit(1), F.char_length(m) - F.char_length(name)), F.array_join(
            F.zip_with(between, F.concat(words, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))
        return (F.when(F.size(own) == 0, m).when(first.type.isin("initial", NAME), named)
                .when(first.type.isin("ip", "ip6"), first.s).otherwise(_written_like(m, first.s)))

    return F.element_at(F.transform(F.array(own), write), 1)


def collisions(entities: DataFrame, key: str, max_rounds: int = 100) -> DataFrame:
    """(type, canonical, attempt) of the distinct (type, canonical) entities whose attempt is not 0.

    Entities keep the surrogates they have won; a round names the losers of the round before
    anew and compares only these with each other, with the real entities and with what is taken. A name's stem is
    taken together with all its endings.
    """
    real = entities.select("type", F.col("canonical").alias("s"))
    # what is compared: letters and digits in order (IP addresses as they are)
    real = real.select("type", F.when(F.col("type").isin("ip", "ip6"), F.col("s")).otherwise(F.regexp_replace("s", r"[^\p{L}\p{N}]", "")).alias("s")).distinct()
    forms = F.when(F.col("type") == NAME, F.array(*[F.concat("s", ending(F.lit(k), F.col("canonical"))) for k in NAME_TYPES])).otherwise(F.array("s"))
    todo, taken, out = entities.withColumn("attempt", F.lit(0)), None, []
    for _ in range(max_rounds):
        named = stored(todo.withColumn("s", surrogate(F.col("type"), F.col("canonical"), F.col("attempt"), key)).withColumn(
            "place", F.row_number().over(Window.partitionBy("type", "s").orderBy("canonical"))), "named")
        small = F.broadcast if fits_broadcast(named, BROADCAST_ROWS) else lambda d: d
        asked = named.select("type", "canonical", F.explode(forms).alias("s"))
        hit = real.join(small(asked), ["type", "s"]).select("type", "canonical")
        if taken is not None:
            hit = hit.unionByName(taken.join(small(named.select("type", "canonical", "s")), ["type", "s"]).select("type", "canonical"))
        hit = stored(hit.distinct(), "hits").withColumn("hit", F.lit(True))
        hit = F.broadcast(hit) if fits_broadcast(hit, BROADCAST_ROWS) else hit
        done = stored(named.join(hit, ["type", "canonical"], "left").select(
            "type", "canonical", "attempt", "s", ((F.col("place") > 1) | F.col("hit").isNotNull()).alias("clash")), "surrogates")
        won = done.filter("not clash")
        out.append(won.filter("attempt > 0").select("type", "canonical", "attempt"))
        if done.filter("clash").isEmpty():
            return reduce(DataFrame.unionByName, out)
        taken = won.select("type", "s") if taken is None else taken.unionByName(won.select("type", "s"))
        todo = done.filter("clash").select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
    raise ValueError(f"surrogates still collide after {max_rounds} rounds")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found) of every row: the text with surrogates, and the types of its replaced entities in order.

    ``key`` makes the surrogates: who has it can compute an entity's surrogate, so keep it secret. Null and empty texts give empty texts. Repeated rows repeat. No rows, or no
    entities: texts come back as they are. Only id and text are read.
    """
    docs = keyed(docs, id_col, text_col)
    matches = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    own = docs.select(*KEY, F.explode(F.array_distinct(matches)).alias("m")).select(*KEY, F.inline(units(F.col("m"))))
    own = own.withColumn("type", entity_of(F.col("type"))).distinct()
    own = stored(own, "entities")
    again = collisions(own.select("type", "canonical").filter("type != 'initial'").distinct(), key)
    name = F.concat_ws("|", "type", "canonical")
    per_doc = own.join(again, ["type", "canonical"]).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_set(F.struct(name.alias("name"), "attempt"))).alias("attempts"))  # a document's own
    per_doc = stored(per_doc, "collisions")
    per_doc = F.broadcast(per_doc) if fits_broadcast(per_doc, BROADCAST_ROWS) else per_doc
    rows = docs.join(per_doc, KEY, "left").select(
        "doc_id", "text", matches.alias("matches"), F.coalesce("attempts", F.create_map().cast("map<string,int>")).alias("attempts"))
    rows = rows.withColumn("names", _persons(F.col("matches")))
    rows = rows.withColumn("pattern", _pattern(F.col("names")))
    rows = rows.withColumn("matches", F.when(F.size("names") == 0, F.col("matches")).otherwise(F.regexp_extract_all("text", "pattern", F.lit(0))))
    kinds = F.filter(F.transform("matches", entity_type), lambda t: t.isNotNull())
    new = F.concat(F.transform("matches", lambda m: _replaced(m, F.col("attempts"), F.col("names"), key)), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split("text", F.col("pattern"), -1), new, lambda a, b: F.concat(a, b)), "")
    return rows.select("doc_id", F.when(F.size("matches") == 0, F.col("text")).otherwise(whole).alias("text"), kinds.alias("found"))
