"""PII replaced by keyed, type-consistent surrogates, in DataFrame operations only.

Entities are found by one pattern of alternatives: e-mail addresses, card and account numbers, IBANs, phone numbers,
social security numbers, IPv4 addresses, assigned credentials and keys of known forms, and names after a form of address. Each has a canonical
form (digits alone, lower case), so that the same entity written in two ways is one. A surrogate is drawn from
sha2(key | type | canonical | attempt): digits for digits, letters for letters in the same case and script, the separators
as they are; cards and account numbers keep their first signs and valid check digits where the original's were valid, addresses stay
valid addresses in the same kind of range, e-mail domains map label by label so that two addresses of one domain keep one.
A name is two entities, the given and the family name, so that a family name by itself and one after a given name stay the
same person's; they follow the form of address in gender and the original in script.

Distinct entities get distinct surrogates over the whole corpus: entities are grouped by surrogate, all but the first of a
collision (and any that equals a real entity) draw again with the next attempt, until there is none. So that this ends at
any number of entities, the space grows with the attempt: names by a syllable, local parts and credentials by a letter,
short phone numbers by a digit, longer ones by the exchange, addresses by wider ranges of their kind (private ones: 10/8,
then the unassigned 240/4). Cards (10^11 a first digit and more), IBANs (10^14 and more), social security numbers (10^9)
and public addresses (3.5 * 10^9) have a form that can't grow: they settle while real ones fill less than half of it.

Texts without entities pass through unmoved. An entity in a third of all documents is one row of the entity table, and its
join back is one that adaptive execution splits.

Nulls: a null text stays null. Empty texts stay empty. Null doc_id and repeated rows: each row is rewritten by its own text.
Ties: of entities that draw one surrogate the smallest canonical form keeps it. Very long texts: rewritten whole. An empty
table gives no rows. Other columns are kept, whatever their names; one of the name asked for the kinds raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KEY = "dispatchgrid"
ROUNDS = 20

#: Forms of address by gender, with the script of the names they go with.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
}
#: Given names by script and gender, and syllables for family names.
GIVEN = {
    ("latin", "f"): "Alba Berta Clara Delia Edith Flora Greta Hanna Ines Jutta Karin Livia Marta Nadia Olga Paula".split(),
    ("latin", "m"): "Anton Bruno Cesar David Emil Felix Georg Hugo Ivan Jakob Karl Leon Marco Nils Oscar Pablo".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Раиса Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён".split(),
    ("greek", "f"): "Άννα Βέρα Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιρις Κλειώ Λήδα Μαρία Νίκη Ξένια Ράνια Σοφία Χλόη".split(),
    ("greek", "m"): "Άρης Βίκτωρ Γιάννης Δήμος Ερμής Ζήνων Ηλίας Θωμάς Ιάσων Κώστας Λέων Μάρκος Νίκος Πάρης Σπύρος Φώτης".split(),
}
SYLLABLES = {
    "latin": "bal der fen gor hal kin lam mor nev ost pel rin sal tor vel win".split(),
    "cyrillic": "бал дер фен гор хал кин лам мор нев ост пел рин сал тор вел вин".split(),
    "greek": "βαλ δερ φεν γορ χαλ κιν λαμ μορ νεβ οστ πελ ριν σαλ τορ βελ ζιν".split(),
}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}[\p{L}'’-]*"
#: What assigns a credential, and bare keys of known forms.
_ASSIGNED = r"(?i:(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key))\s{0,3}[=:]\s{0,3}"
_PREFIX = "AKIA|ASIA|gh[pousr]_|xox[baprs]-|sk-"
_KEYS = "(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}"
#: type -> pattern, tried in this order at each place. The JVM matches a repeated group by recursion, so each such group is
#: bounded: a domain has 127 labels at the most, and an unquoted value its first digit among its first 256 signs.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}(?![A-Za-z0-9])",
    "credential": rf"{_ASSIGNED}(?:[\"'][^\"'\s]{{8,}}[\"']|(?=[^\"'\s]{{0,256}}\d)[A-Za-z0-9+/=_!@#$%^&*.-]{{8,}})|(?<![A-Za-z0-9])(?:{_KEYS})(?![A-Za-z0-9])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.+-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3\d{3}([ -]?)\d{6}\2\d{5})(?![\w-])",
    "phone": r"(?<![\w.+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.?[ \u00A0](?:{_NAME})(?:[ \u00A0](?!(?:{_TITLE})(?!\p{{L}})){_NAME})?",
}


def _join(patterns: dict[str, str]) -> str:
    """One pattern of all; the groups that back-references name keep their order."""
    shift, parts = 0, []
    for p in patterns.values():
        groups = 2 if r"\2" in p else 1 if r"\1" in p else 0
        for g in range(groups, 0, -1):
            p = p.replace(f"\\{g}", f"\\{g + shift}") if shift else p
        shift += groups
        parts.append(p)
    return "|".join(f"(?:{p})" for p in parts)


PATTERN = _join(PATTERNS)
#: What a text must hold at the least for PATTERN to match anywhere in it.
HINT = rf"@|\d[ .-]?\d\d|\d\.\d|[=:]\s{{0,3}}[\"']|{_ASSIGNED}|{_PREFIX}|(?<![\p{{L}}])(?:{_TITLE})\.?[ \u00A0]"


def kind_of(raw: Column) -> Column:
    out = F.lit("name")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(raw.rlike("^(?:" + PATTERNS[k] + ")$"), F.lit(k)).otherwise(out)
    # A number that fails the check digit or starts as no card does is none.
    digits = F.regexp_replace(raw, r"\D", "")
    card = digits.rlike("^[2-6]") & (_check_sum(digits) % 10 == 0)
    return F.when((out == "card") & ~card, F.lit("number")).otherwise(out)


def canonical(kind: Column, raw: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(raw, f"^{_ASSIGNED}[\"']?", ""), "[\"']$", "")
    digits = F.regexp_replace(raw, r"\D", "")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "credential", value)
        .when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .otherwise(raw)
    )


def name_parts(raw: Column) -> Column:
    """(kind, canon, lead) of a name after its form of address: the given name, if there are two words, and the family name;
    lead is what stands before it in the text."""
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.?[ \u00A0]", 0)
    words = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), "[ \u00a0]")
    given = F.struct(F.lit("given").alias("kind"), F.concat(_gender(raw), F.lit("|"), F.lower(F.get(words, F.lit(0)))).alias("canon"), title.alias("lead"))
    family = lambda at, lead: F.struct(F.lit("family").alias("kind"), F.lower(F.get(words, F.lit(at))).alias("canon"), lead.alias("lead"))
    return F.when(F.size(words) > 1, F.array(given, family(1, F.lit(" ")))).otherwise(F.array(family(0, title)))


def _gender(raw: Column) -> Column:
    return F.when(raw.rlike("^(?:" + "|".join(TITLES["f"]) + r")\b"), F.lit("f")).otherwise(F.lit("m"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(text.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(h: Column, at: int, below: int | Column) -> Column:
    return (F.conv(F.substring(h, at, 7), 16, 10).cast("long") % below).cast("int")


def _like(text: Column, h: Column) -> Column:
    """Each digit and ASCII letter replaced by one of its kind drawn from h; the rest stays."""
    n = F.length(h)
    nibble = lambda i: F.conv(F.substring(h, i % (n - 1) + 1, 2), 16, 10).cast("int")
    one = lambda c, i: (
        F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), nibble(i) % 10 + 1, F.lit(1)))
        .when(c.rlike("[a-f]"), F.substring(F.lit("abcdef"), nibble(i) % 6 + 1, F.lit(1)))
        .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), nibble(i) % 26 + 1, F.lit(1)))
        .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), nibble(i) % 26 + 1, F.lit(1)))
        .otherwise(c)
    )
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, one), "")


def _more(h: Column, n: Column, letters: str) -> Column:
    """n further signs, each one of sixteen."""
    return F.translate(F.substring(h, F.lit(33), n), "0123456789abcdef", letters)


def _check_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = lambda x: x * 2 - F.when(x * 2 > 9, 9).otherwise(0)
    return F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _card(canon: Column, h: Column) -> Column:
    drawn = F.concat(F.substring(canon, 1, 1), F.substring(_like(canon, h), F.lit(2), F.length(canon) - 2))
    last = (10 - _check_sum(F.concat(drawn, F.lit("0"))) % 10) % 10
    valid = _check_sum(canon) % 10 == 0
    return F.concat(drawn, F.when(valid, last).otherwise((last + 1 + _number(h, 50, 9)) % 10).cast("string"))


def _phone(canon: Column, h: Column, attempt: Column) -> Column:
    """Country and area digits change within 2-9 where they lead; the last seven keep a fictional exchange at first."""
    n = F.length(canon)
    new = _like(canon, h)
    lead = F.substring(canon, F.lit(1), n - 10)
    area = F.concat((_number(h, 1, 8) + 2).cast("string"), F.substring(new, n - 8, F.lit(2)))
    return F.when(n >= 10, F.concat(F.when(n > 10, lead).otherwise(""), area, F.when(attempt < 2, "555").otherwise(F.substring(new, n - 6, F.lit(3))), F.substring(new, n - 3, F.lit(4)))).otherwise(F.concat(new, _more(h, F.least(attempt, 15 - n), "0123456789012345")))


def _ip(canon: Column, h: Column, attempt: Column) -> Column:
    octets = F.split(canon, r"\.")
    inside = F.get(octets, F.lit(0)).isin("10", "127") | canon.startswith("192.168.")
    keep = F.when(canon.startswith("192.168."), 2).when(inside, 1).otherwise(0)
    number = lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(6)), 16, 10).cast("long")
    four = F.array(*(F.lit(i) for i in range(4)))
    drawn = F.transform(four, lambda i: F.when(i < keep, F.get(octets, i)).otherwise((number(i) % F.when(i == 0, 97).otherwise(254) + F.when(i == 0, 128).otherwise(1)).cast("string")))
    public = 11 + number(F.lit(0)) % 212
    first = F.when(~inside, F.when(public == 127, 223).otherwise(public)).when(attempt < 4, 10).otherwise(240 + number(F.lit(0)) % 15)
    wide = F.transform(four, lambda i: F.when(i == 0, first).otherwise(number(i) % 256).cast("string"))
    return F.array_join(F.when(attempt < 2, drawn).otherwise(wide), ".")


def _email(canon: Column, h: Column, attempt: Column, key: str) -> Column:
    local, domain = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(canon, F.lit("@"), F.lit(2))
    suffix = F.regexp_extract(domain, r"\.[a-z]+$", 0)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(suffix))
    return F.concat(_like(local, h), _more(h, attempt, "abcdefghijklmnop"), F.lit("@"), _like(labels, _hex(key, F.lit("domain"), domain)), suffix)


def _pick(values: list[str], h: Column, at: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), _number(h, at, len(values)))


def _nth(values: Column, h: Column):
    """The i-th further pick of sixteen values."""
    return lambda i: F.get(values, F.conv(F.substring(h, i + 32, F.lit(1)), 16, 10).cast("int"))


def _credential(canon: Column, h: Column, attempt: Column) -> Column:
    """The prefix of a known form stays. One of signs that have no like is drawn from letters when it comes again."""
    prefix = F.regexp_extract(canon, f"^(?:{_PREFIX})", 0)
    body = F.substring(canon, F.length(prefix) + 1, F.length(canon))
    return F.concat(prefix, F.when(attempt < 1, _like(body, h)).otherwise(F.concat(_like(F.regexp_replace(body, "[^A-Za-z0-9]", "z"), h), _more(h, attempt, "abcdefghijklmnop"))))


def _name(kind: Column, canon: Column, h: Column, attempt: Column) -> Column:
    """A given name of the gender from the list, a family name of three syllables; one that comes again gets more of them."""
    gender = F.split_part(canon, F.lit("|"), F.lit(1))
    out = F.lit(None).cast("string")
    for script in SYLLABLES:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        further = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), attempt), lambda i: i > 0), _nth(syllables, h)), "")
        family = F.concat(*(_pick(SYLLABLES[script], h, at) for at in (1, 9, 17)), further)
        given = F.concat(F.when(gender == "f", _pick(GIVEN[script, "f"], h, 25)).otherwise(_pick(GIVEN[script, "m"], h, 25)), further)
        out = F.when(_script(canon) == script, F.when(kind == "given", given).otherwise(F.initcap(family))).otherwise(out)
    return out


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an account number whose first four signs come last, letters as 10 to 35."""
    signs = F.filter(F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), ""), lambda c: c != "")
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(signs, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97)


def _iban(canon: Column, h: Column) -> Column:
    """The country stays; check digits are valid where the original's are."""
    country, body = F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), F.length(canon)), h)
    check = 98 - _mod97(F.concat(country, F.lit("00"), body))
    wrong = (check + 1 + _number(h, 50, 90)) % 97
    return F.concat(country, F.lpad(F.when(_mod97(canon) == 1, check).otherwise(wrong).cast("string"), 2, "0"), body)


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    h = _hex(key, kind, canon, attempt.cast("string"))
    return (
        F.when(kind == "email", _email(canon, h, attempt, key))
        .when(kind == "card", _card(canon, h))
        .when(kind == "phone", _phone(canon, h, attempt))
        .when(kind == "ip", _ip(canon, h, attempt))
        .when(kind.isin("given", "family"), _name(kind, canon, h, attempt))
        .when(kind == "credential", _credential(canon, h, attempt))
        .when(kind == "iban", _iban(canon, h))
        .otherwise(_like(canon, h))
    )


def formatted(kind: Column, raw: Column, sur: Column, lead: Column) -> Column:
    """The surrogate written as the original is: its separators, prefix and quotes, or what stands before a name."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.struct(
        F.concat(a["out"], F.when(c.rlike("[0-9A-Z]"), F.substring(sur, a["at"], F.lit(1))).otherwise(c)).alias("out"),
        (a["at"] + F.when(c.rlike("[0-9A-Z]"), 1).otherwise(0)).alias("at"),
    )
    # What a longer surrogate has left comes after the last place.
    spread = F.aggregate(chars, start, step, lambda a: F.concat(a["out"], F.substring(sur, a["at"], F.length(sur))))
    assigned = F.regexp_extract(raw, f"^{_ASSIGNED}[\"']?", 0)
    return (
        F.when(kind == "credential", F.concat(assigned, sur, F.regexp_extract(raw, "[\"']$", 0)))
        .when(kind.isin("given", "family"), F.concat(lead, sur))
        .when(kind.isin("card", "phone", "ssn", "iban"), spread)
        .otherwise(sur)
    )


def entity_table(found: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, sur of distinct entities; surrogates are distinct within a kind and equal no real entity."""
    e = scratch.keep(found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), "entities-0")
    for i in range(1, ROUNDS + 1):
        drawn = scratch.keep(e.withColumn("sur", draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)), f"drawn-{i}")
        taken = drawn.groupBy("kind", "sur").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        # Names are canonical in small letters, given ones with their gender before them; surrogates are as written.
        written = F.when(F.col("kind") == "family", F.initcap("canon")).when(F.col("kind") == "given", F.initcap(F.substring_index("canon", "|", -1))).otherwise(F.col("canon"))
        real = drawn.select("kind", written.alias("sur"), F.lit(True).alias("real")).distinct()
        again = drawn.join(taken, ["kind", "sur"]).join(real, ["kind", "sur"], "left").withColumn("again", F.coalesce("real", F.lit(False)) | (F.col("canon") != F.col("owner")))
        if not again.where("again").limit(1).count():
            return drawn
        e = scratch.keep(again.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), f"entities-{i}")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_pii(docs: DataFrame, key: str = KEY, kinds: str | None = "pii_kinds") -> DataFrame:
    """All rows and columns of docs, text rewritten, and in `kinds` (unless None) the kinds replaced, in order of place."""
    if kinds in docs.columns:
        raise ValueError(f"docs has a column {kinds} already")
    scratch = Scratch(docs.sparkSession, "surrogates")
    names = [f"__{i}" for i in range(len(docs.columns))]  # so that no column clashes with those below
    at = names[docs.columns.index("text")]
    text = F.col(at)
    own = docs.toDF(*names).withColumn("pii", F.coalesce(text.rlike(HINT), F.lit(False)) & F.coalesce(text.rlike(PATTERN), F.lit(False)))
    clean = own.where("not pii").select(*names, F.array().cast("array<string>").alias("pii_kinds"))
    # Texts that hold something are matched once: what was found, and what stands between.
    dirty = own.where("pii").select(*names, F.sha2(text, 256).alias("t"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("raws"), F.split(text, PATTERN, -1).alias("between"))
    dirty = scratch.keep(dirty, "dirty")

    raw = dirty.groupBy("t").agg(F.first("raws").alias("raws")).select("t", F.posexplode("raws").alias("place", "raw")).withColumn("found", kind_of(F.col("raw")))
    single = F.array(F.struct(F.col("found").alias("kind"), canonical(F.col("found"), F.col("raw")).alias("canon"), F.lit("").alias("lead")))
    parts = raw.select("t", "place", "raw", "found", F.posexplode(F.when(F.col("found") == "name", name_parts(F.col("raw"))).otherwise(single)).alias("part", "p"))
    found = scratch.keep(parts.select("t", "place", "part", "raw", "found", "p.*"), "found")
    table = entity_table(found.where("found <> 'number'"), scratch, key)
    put = found.join(table.select("kind", "canon", "sur"), ["kind", "canon"], "left")
    new = F.coalesce(formatted(F.col("kind"), F.col("raw"), F.col("sur"), F.col("lead")), F.col("raw"))
    put = put.select("t", "place", "part", "found", new.alias("new"))
    at_place = put.groupBy("t", "place", "found").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda p: p["new"]), "").alias("new"))
    lists = at_place.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("place", "found", "new"))).alias("put"))

    joined = dirty.join(lists, "t")
    whole = F.array_join(F.transform("between", lambda s, i: F.concat(s, F.coalesce(F.get(F.col("put"), i)["new"], F.lit("")))), "")
    out = joined.select(*(whole.alias(n) if n == at else n for n in names), F.filter(F.transform("put", lambda p: p["found"]), lambda k: k != "number").alias("pii_kinds"))
    every = clean.union(out)
    return every.toDF(*docs.columns, kinds) if kinds else every.drop("pii_kinds").toDF(*docs.columns)
