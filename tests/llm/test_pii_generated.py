"""Personal data planted in generated texts: all of it replaced, one to one, and nothing else touched."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nextbuy.llm import pii
from nextbuy.llm.pii import replace_pii


def luhn_digit(digits):
    s = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
    return (10 - s % 10) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(18))
    return f"DE{98 - mod97(body + 'DE00'):02d}{body}"


def entities(rnd):
    """(type, canonical, written forms)."""
    out = []
    for _ in range(25):
        d = [rnd.randint(0, 9) for _ in range(10)]
        area, mid, last = f"{rnd.randint(201, 665)}", f"{rnd.randint(201, 999)}", f"{rnd.randint(1, 9999):04d}"
        out.append(("phone", area + mid + last, [f"{area}-{mid}-{last}", f"({area}) {mid}-{last}", f"{area} {mid} {last}", f"{area}.{mid}.{last}"]))
        two = f"{rnd.randint(1, 99):02d}"
        out.append(("ssn", area + two + last, [f"{area}-{two}-{last}", f"{area} {two} {last}"]))
        card = [4, *d, *(rnd.randint(0, 9) for _ in range(4))]
        card = "".join(map(str, [*card, luhn_digit(card)]))
        out.append(("card", card, [card, " ".join(card[i:i + 4] for i in range(0, 16, 4)), "-".join(card[i:i + 4] for i in range(0, 16, 4))]))
        a = iban(rnd)
        out.append(("iban", a, [a, " ".join(a[i:i + 4] for i in range(0, 22, 4))]))
        ip = ".".join(str(rnd.randint(100, 255)) for _ in range(4))
        out.append(("ip", ip, [ip]))
        ip6 = ":".join(f"{rnd.randint(4096, 65535):x}" for _ in range(8)) if rnd.random() < 0.5 else f"2001:db8::{rnd.randint(4096, 65535):x}:{rnd.randint(4096, 65535):x}"
        out.append(("ip6", ip6, [ip6, ip6.upper()]))
        mail = f"{''.join(rnd.choice('abcdefgh') for _ in range(7))}.{rnd.choice('xyz')}@mail{rnd.randint(1, 99)}.example.org"
        out.append(("email", mail, [mail, mail.title(), mail.upper()]))
        secret = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        out.append(("secret", secret, [secret]))
    return out


def norm(kind, written):
    if kind in ("phone", "ssn", "card"):
        return re.sub(r"\D", "", written)
    return re.sub(" ", "", written).lower()


def test_generated_texts(spark):
    rnd = random.Random(8)
    known = entities(rnd)
    words = ["the report", "was sent", "to us on", "Monday", "version 3.1", "see 12:30", "page 44", "No. 7", "at 9:15", "cost 1,200", "http://a.b/c", "x::y", "GB12", "A1B2"]
    docs = []
    for i in range(200):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) + " / ")
            kind, canonical, forms = rnd.choice(known)
            parts.append((kind, canonical, rnd.choice(forms)))
            parts.append(" ; ")
        docs.append((i, parts))
    rows = [(i, "".join(p if isinstance(p, str) else p[2] for p in parts)) for i, parts in docs]
    got = {r.doc_id: r for r in replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    real = {(k, norm(k, c)) for k, c, _ in known}
    new_of, old_of = defaultdict(set), defaultdict(set)
    for i, parts in docs:
        planted = [p for p in parts if not isinstance(p, str)]
        assert got[i].found == [k for k, _, _ in planted]
        m = re.fullmatch("".join(re.escape(p) if isinstance(p, str) else "(.+?)" for p in parts), got[i].text)
        assert m, (rows[i], got[i].text)
        for (kind, canonical, written), new in zip(planted, m.groups(), strict=True):
            s = norm(kind, new)
            assert (kind, s) not in real
            new_of[kind, norm(kind, canonical)].add(s)
            old_of[kind, s].add(norm(kind, canonical))
            if kind not in ("ip", "ip6"):  # the same form
                shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t)))
                assert shape(new) == shape(written) or kind in ("secret", "email")
            if kind == "card":
                assert luhn_digit([int(c) for c in s[:-1]]) == int(s[-1]) and s[0] == "4"
            if kind == "iban":
                assert mod97(s[4:].upper() + s[:4].upper()) == 1 and s[:2] == "de"
    assert all(len(v) == 1 for v in new_of.values()) and all(len(v) == 1 for v in old_of.values())


PEOPLE = [
    (1, "Dr. Jane Smith came. Mrs. Jane Smith left. Jane slept."), (2, "Jane spoke to Dr. Jane Doe."), (3, "Mr. de la Cruz and Mr. van Gogh met Sra. María de los Ángeles."),
    (4, "Sir John Brown, Lady Ann Lee, Captain Cook and Don José García."), (5, "Mrs. Kim said. Dr. Kim said."), (6, "Mr. Kim Lee, Professor Ann Kim"),
]


def test_one_person_one_name(spark):
    of = {r.doc_id: r.text for r in replace_pii(spark.createDataFrame(PEOPLE, "doc_id long, text string"), key="k").collect()}
    jane, smith = re.match(r"Dr\. (\w+) (\w+) came", of[1]).groups()
    assert of[1] == f"Dr. {jane} {smith} came. Mrs. {jane} {smith} left. {jane} slept." and jane.endswith("na")
    other = re.match(r"(\w+) spoke to Dr\. (\w+) (\w+)\.", of[2]).groups()
    assert other[0] == other[1] == jane.removesuffix("na") + "lin"  # the same stem, no gender known here
    m = re.fullmatch(r"Mr\. de la (\w+) and Mr\. van (\w+) met Sra\. (\w+) de los (\w+)\.", of[3])
    assert m and m[3].endswith("na") and not re.search("Cruz|Gogh|María|Ángeles", of[3])
    assert re.fullmatch(r"Sir \w+nor \w+dson, Lady \w+na \w+dson, Captain \w+dson and Don \w+nor \w+dson\.", of[4]) and not re.search("John|Brown|Ann|Lee|Cook|Jos|Garc", of[4])
    kim = re.match(r"Mrs\. (\w+) said\. Dr\. (\w+) said", of[5]).groups()
    assert kim[0] == kim[1]
    stem = kim[0].removesuffix("dson")
    assert re.fullmatch(rf"Mr\. {stem}nor \w+dson, Professor \w+lin {stem}nor", of[6])  # one type for a name in a document


def test_stems_and_endings_stay_distinct(spark, monkeypatch):
    """Few stems: names of all types, and real names that look like surrogates."""
    monkeypatch.setattr(pii, "LATIN", ("bd", "ae", pii.LATIN[2]))
    stems = {r.s for r in spark.range(40).select(pii.surrogate(F.lit(pii.NAME), F.concat(F.lit("x"), F.col("id").cast("string")), F.lit(0), "k").alias("s")).collect()}
    real = [f"Mrs. X{i} Y{i}" for i in range(60)] + [f"Mr. {s.title()}nor {s.title()}dson" for s in sorted(stems)]
    real = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in real]
    d = spark.createDataFrame(list(enumerate(real)), "doc_id long, text string").coalesce(2)
    new = [r.text for r in replace_pii(d, key="k").collect()]
    words = [{w.lower() for t in side for w in t.split()[1:]} for side in (real, new)]
    assert len(words[0]) == len(words[1]) and not words[0] & words[1]


def test_the_key_is_required(spark):
    with pytest.raises(TypeError):
        replace_pii(spark.createDataFrame([(1, "x")], "doc_id long, text string"))


def test_alike_but_nothing(spark):
    texts = ["DE00 3704 0044 0532 0130 00", "1:2:3", "12:30:45", "a::b", "std::vector", "000 12 3456", "666 12 3456 9", "123 456 7890", "1 487 555 7209 2", "Don't Stop", "sir john"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in replace_pii(d, key="k").collect()} == dict(enumerate(texts))
