"""Surrogates for personal data and secrets, in DataFrame operations only.

Entities are found by patterns, given a canonical form (so that one phone number in two spellings is one
entity) and replaced by a keyed, type-consistent stand-in: letters for letters, digits for digits, the
separators, case, script and gender as they were, check digits right where they were right. One table
of entities gives each its stand-in: two entities never share one, none is another's original, and
an entity has the same one wherever it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

# Titles by gender and script, given names by gender and script, syllables of family names.
_MALE = "Mr|Sir|Herr|Monsieur|Señor|Signor|господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Señora|Signora|госпожа|г-жа"
_GIVEN = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul",
    ("female", "latin"): "Alma Berta Clara Diana Elena Flora Greta Hanna Irma Julia Karla Laura Maria Nora Olga Paula",
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий",
    ("female", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина София Юлия",
}
_SYLLABLES = {"latin": "ba de fi go hu ka le mi no pu ra se ti vo wu za", "cyrillic": "ба де фи го ху ка ле ми но пу ра се ти во лу за"}

_KEYS = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
_NAMED = rf"{_KEYS}[^\w\n]{{0,4}}[=:][^\w\n]{{0,4}}"
# A word of a name: initials, or a capitalised word, a single letter only before another one.
_WORD = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|zu) ){0,3}(?:(?:\p{Lu}\.[\-]?)+|\p{Lu}[\p{L}'’\-]+|\p{Lu}(?= \p{Lu}))"
# An entity's kind and pattern; the first that fits a match names its kind.
_PATTERNS = {
    # A named value goes up to its closing quote, or to white space; one without letter or digit is none.
    "secret": rf"(?<=[^\w\n])(?<={_NAMED})(?:(?<=\")(?=[^\"\n]*[\p{{L}}\p{{N}}])[^\"\n]+(?=\")|(?<=')(?=[^'\n]*[\p{{L}}\p{{N}}])[^'\n]+(?=')|(?![\"'])(?=\S*[\p{{L}}\p{{N}}])\S+)|\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b|\bgh[pousr]_[A-Za-z0-9]{{36,}}|\bsk-[A-Za-z0-9]{{20,}}",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])[3-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{2,4}(?![\w\-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "name": rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE})\.?(?: {_WORD})+",
}
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:[23][0-9A-Fa-f]{{3}}|[Ff][CcDd][0-9A-Fa-f]{{2}}|[Ff][Ee][89ABab][0-9A-Fa-f])(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:]|\.\w)"
_PATTERNS["ip6"] = _IP6
_ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: What every entity has one of, by its pattern's own fixed parts: most texts are passed by this alone.
_MAYBE = rf"[@0-9]|{_MALE}|{_FEMALE}|{_KEYS}|AKIA|ASIA|gh[pousr]_|sk-"
#: Words before which a name alone is a common word ("a Long road", "in May").
_NO_PERSON = r"(?<!\p{L})(?:a|an|in|this|next|last|every|until|since|ein|eine|im|un|une|en)"
ROUNDS = 12


def _hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as hex text."""
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))), 256)


def _kind(found: Column, before: Column) -> Column:
    """The kind of a match, by its look and what stands before it. Long numbers whose check digit is
    wrong are no cards: their kind is none."""
    last = F.when(found.rlike(rf"^(?:{_MALE}|{_FEMALE})\.? "), "name").otherwise("secret")
    for kind in ("card", "ssn", "phone", "iban", "ip", "ip6", "email"):
        last = F.when(found.rlike(f"^(?:{_PATTERNS[kind]})$"), kind).otherwise(last)
    last = F.when(before.rlike(f"{_NAMED}$"), "secret").otherwise(last)
    wrong = F.pmod(_luhn_sum(F.regexp_replace(found, "[^0-9]", "")), F.lit(10)) != 0
    return F.when((last == "card") & wrong, "none").otherwise(last)


def _ip6_groups(found: Column) -> Column:
    """The address with all its eight groups of four digits."""
    parts = lambda text: F.filter(F.split(F.lower(text), ":"), lambda x: x != "")
    head, tail = parts(F.substring_index(found, "::", 1)), parts(F.substring_index(found, "::", -1))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail))
    groups = F.when(found.contains("::"), F.concat(head, zeros, tail)).otherwise(parts(found))
    return F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), ":")


def _canonical(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(found))
        .when(kind == "ip6", _ip6_groups(found))
        .when(kind == "name", F.lower(F.regexp_extract(found, r"(\S+)$", 1)))
        .otherwise(found)
    )


def _person(kind: Column, found: Column) -> Column:
    """The entity of a name with given names: gender, script, family name, given names; null for others."""
    title, given = F.regexp_extract(found, rf"^((?:{_MALE}|{_FEMALE})\.? )", 1), F.regexp_extract(found, rf"^(?:{_MALE}|{_FEMALE})\.? (.+) \S+$", 1)
    gender = F.when(title.rlike(rf"^(?:{_FEMALE})\.? $"), "female").otherwise("male")
    script = F.when(found.rlike(r"\p{IsCyrillic}\S*$"), "cyrillic").otherwise("latin")
    return F.when((kind == "name") & (given != ""), F.concat_ws("\u0001", gender, script, _canonical(kind, found), F.lower(given)))


def _shaped(like: Column, stream: Column) -> Column:
    """`like` with digits for its digits, letters of the same case for its letters."""
    digits, letters = F.translate(stream, "abcdef", "135790"), F.translate(stream, "0123456789abcdef", "bcdfghjklmnpqrst")
    at = lambda s, i: F.substr(s, F.pmod(i, F.lit(120)) + 1, F.lit(1))
    return F.array_join(
        F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike("[a-z]"), at(letters, i)).when(c.rlike("[A-Z]"), F.upper(at(letters, i))).otherwise(c)), ""
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a text of digits, the last one undoubled."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - 1 - i) % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x,
    )


def _stand_in(kind: Column, canonical: Column, attempt: Column, key: bytes) -> Column:
    """The canonical form of the stand-in that an entity gets at this attempt."""
    mark = F.concat_ws("\u0001", kind, canonical, attempt.cast("string"))
    stream = F.concat(_hmac(key, mark), _hmac(key, F.concat(mark, F.lit("\u0002"))))
    # Letters of any script are replaced; a short form gets longer the more often it clashed.
    plain = F.when(kind == "secret", F.regexp_replace(canonical, r"[^\x00-\x7F]", "x")).otherwise(canonical)
    shaped = F.concat(_shaped(plain, stream), F.when((kind == "secret") & (attempt > 2), F.substr(stream, F.lit(90), attempt)).otherwise(""))
    octet = lambda k: (F.conv(F.substring(stream, 1 + 4 * k, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    group = lambda k: F.concat(F.translate(F.substring(stream, k, 1), "0", "1"), F.substring(stream, k + 1, 3))
    unchecked = F.concat(F.substring(canonical, 1, 1), F.expr("substr(shaped, 2)"))
    body = F.expr("substr(first, 1, length(first) - 1)")
    check = F.when(F.pmod(_luhn_sum(canonical), F.lit(10)) == 0, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")).otherwise(F.substr(unchecked, F.lit(-1), F.lit(1)))
    script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    family = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 4), lambda k: F.element_at(F.split(F.when(script == "cyrillic", _SYLLABLES["cyrillic"]).otherwise(_SYLLABLES["latin"]), " "), F.conv(F.substr(stream, k, F.lit(1)), 16, 10).cast("int") + 1)), "")
    part = lambda k: F.split(canonical, "\u0001")[k]
    names = F.lit(_GIVEN["male", "latin"])
    for (g, s), words in _GIVEN.items():
        names = F.when((part(0) == g) & (part(1) == s), words).otherwise(names)
    # One of 16 at first, of 16 times as many at each further attempt; distinct inside a family.
    given = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 1), lambda k: F.element_at(F.split(names, " "), F.conv(F.substr(stream, k, F.lit(1)), 16, 10).cast("int") + 1)), "-")
    host = F.concat(F.translate(F.substring(stream, 70, 10), "0123456789abcdef", "bcdfghjklmnpqrst"), F.lit(".example.com"))
    local = _shaped(F.substring_index(canonical, "@", 1), stream)
    hexadecimal = canonical.rlike("^[0-9a-f]+$")
    head = F.regexp_extract(canonical, r"^(AKIA|ASIA|gh[pousr]_|sk-)?", 1)
    values = {"shaped": shaped, "first": unchecked}
    out = (
        F.when(kind == "email", F.concat(local, F.lit("@"), host))
        .when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))
        .when(kind == "ip6", F.concat_ws(":", F.lit("2001:0db8"), group(1), group(5), F.lit("0000:0000"), group(9), group(13)))
        .when(kind == "card", F.concat(body, check))
        .when(kind == "phone", F.concat(F.substring(canonical, 1, 1), F.expr("substr(shaped, 2)")))
        .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), F.expr("substr(shaped, 3)")))
        .when(kind == "name", family)
        .when(kind == "given", F.concat_ws("\u0001", part(2), given))
        .when((kind == "secret") & hexadecimal, F.rpad(stream, F.length(canonical), stream))
        .when(kind == "secret", F.concat(head, F.substr(F.col("shaped"), F.length(head) + 1)))
        .otherwise(F.col("shaped"))
    )
    return values, out


def entities(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, stand_in for the distinct entities of found (kind, canonical).

    Every entity takes its keyed candidate. Where several take the same, all but one (the smallest
    attempt, then canonical form) try their next, as does one whose candidate is an original; each
    round looks at the whole table and ends when no candidate clashes.
    """
    taken = materialize(found.groupBy("kind", "canonical").agg(F.lit(0).alias("attempt")), "entities")
    originals = taken.select(F.col("canonical").alias("original")).distinct()
    for _ in range(ROUNDS):
        values, out = _stand_in(F.col("kind"), F.col("canonical"), F.col("attempt"), key)
        shaped = taken.withColumn("shaped", values["shaped"]).withColumn("first", values["first"]).withColumn("stand_in", out).drop("shaped", "first")
        same = Window.partitionBy("kind", "stand_in").orderBy("attempt", "canonical")
        tried = shaped.withColumn("place", F.row_number().over(same)).join(originals, F.col("stand_in") == F.col("original"), "left")
        tried = materialize(tried.select("kind", "canonical", "attempt", "stand_in", ((F.col("place") > 1) | F.col("original").isNotNull()).alias("clash")), "tried")
        if tried.where("clash").isEmpty():
            break
        taken = tried.select("kind", "canonical", F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
    else:
        # A form too short to have enough distinct stand-ins: its place among them is added.
        tried = tried.withColumn("stand_in", F.when(F.col("clash"), F.concat("stand_in", F.lit("-"), F.substring(F.sha2("canonical", 256), 1, 16))).otherwise(F.col("stand_in")))
    return tried.select("kind", "canonical", "stand_in")


def _written(kind: Column, found: Column, stand_in: Column, given: Column) -> Column:
    """The stand-in in the spelling of the match."""
    spelled = F.array_join(
        F.transform(F.split(found, ""), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substr(stand_in, F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), "[^A-Z0-9]", "")), F.lit(1))).otherwise(c)), ""
    )
    title = F.regexp_extract(found, rf"^((?:{_MALE}|{_FEMALE})\.? )", 1)
    name = F.concat(title, F.when(given.isNotNull(), F.concat(F.substring_index(given, "\u0001", -1), F.lit(" "))).otherwise(""), F.initcap(stand_in))
    short = F.when(found.contains("::"), F.replace(F.replace(stand_in, F.lit(":0000:0000:"), F.lit("::")), F.lit(":0db8:"), F.lit(":db8:"))).otherwise(stand_in)
    address = F.when(found.rlike("[A-F]"), F.upper(short)).otherwise(short)
    return F.when(kind == "ip6", address).when(kind.isin("phone", "card", "ssn", "iban"), spelled).when(kind == "name", name).when((kind == "email") & (found == F.upper(found)), F.upper(stand_in)).otherwise(stand_in)


def _people(kind: Column, found: Column, stand_in: Column, given: Column) -> Column:
    """How a person may be named again, and what stands for it: given names and family name, or either alone.
    What a text also writes in lower case is a word of it: see replace_entities."""
    family = F.regexp_extract(found, r"(\S+)$", 1)
    first = F.regexp_extract(found, rf"^(?:{_MALE}|{_FEMALE})\.? (.+) \S+$", 1)
    new = F.initcap(stand_in)
    pair = lambda old, said: F.struct(old.alias("old"), said.alias("said"))
    none = F.lit(None).cast("struct<old:string,said:string>")
    full = F.when(given.isNotNull(), pair(F.concat_ws(" ", first, family), F.concat_ws(" ", F.substring_index(given, "\u0001", -1), new))).otherwise(none)
    alone = F.when(given.isNotNull() & first.rlike(r"^\p{Lu}\p{Ll}{2,}"), pair(first, F.substring_index(given, "\u0001", -1))).otherwise(none)
    both = F.array(full, pair(family, new), alone)
    return F.filter(F.when((kind == "name") & stand_in.isNotNull(), both), lambda p: p.isNotNull() & (F.length(p["old"]) > 2))


def _named_again(gap: Column, people: Column) -> Column:
    """Text between matches, with people that its document has introduced by a title replaced where they are named again."""
    quoted = F.transform(F.reverse(F.array_sort(F.transform(people, lambda p: F.struct(F.length(p["old"]).alias("n"), p["old"].alias("old"))))), lambda p: F.concat(F.lit(r"\Q"), p["old"], F.lit(r"\E")))
    pattern = F.concat(F.lit(rf"(?<![\p{{L}}\p{{N}}])(?<!{_NO_PERSON} )(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    said = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda m: F.element_at(F.filter(people, lambda p: p["old"] == m), 1)["said"])
    done = F.array_join(F.zip_with(F.split(gap, pattern, -1), F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.size(people) > 0, done).otherwise(gap)


def replace_entities(docs: DataFrame, key: bytes = b"millrace") -> DataFrame:
    """docs with entities in text replaced, and n_entities, how many were.

    A person found behind a title is replaced wherever the same document names them again, by given names and family
    name or by either alone (of three letters or more); n_entities does not count these. Of two people with one given name, the
    one whose stand-in is the smaller text stands for it alone. A name alone is none
    where the same text writes it in lower case as well, nor behind an article or a preposition of time.

    Null texts stay null, with 0. Texts are replaced whole, however long. Repeated rows are each replaced alike. Of entities with one candidate the one
    of fewer attempts, then of smaller form, keeps it. A column n_entities is replaced; names that
    begin with two underscores are this function's own; all others are kept. An empty table gives an empty one.

    All texts are read once; only documents with an entity meet the entity table, through their
    matches. An entity that a third of all documents hold is one row of that table; its matches
    are joined by a skew join or a broadcast that Spark chooses by size.
    """
    keep = [c for c in docs.columns if c != "n_entities"]
    text = F.col("text")
    matches = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = materialize(docs.select(*keep).withColumn("__row", F.monotonically_increasing_id()).withColumn("__found", F.coalesce(matches, F.array().cast("array<string>"))), "matches")
    gaps = F.split(text, _ANY, -1)
    each = F.zip_with("__found", gaps, lambda found, gap: F.struct(found.alias("_match"), F.right(gap, F.lit(40)).alias("_before")))
    one = rows.where(F.size("__found") > 0).select("__row", F.posexplode(each).alias("_at", "_one")).select("__row", "_at", "_one.*").where("_match is not null")
    one = one.withColumn("kind", _kind(F.col("_match"), F.col("_before"))).withColumn("canonical", _canonical(F.col("kind"), F.col("_match"))).withColumn("_person", _person(F.col("kind"), F.col("_match")))
    found = F.explode(F.array(F.struct("kind", "canonical"), F.struct(F.lit("given").alias("kind"), F.col("_person").alias("canonical"))))
    known = entities(one.where("kind <> 'none'").select(found.alias("_e")).select("_e.*").where("canonical is not null"), key)
    given = known.where("kind = 'given'").select(F.col("canonical").alias("_person"), F.col("stand_in").alias("_given"))
    said = F.when(F.col("stand_in").isNull(), F.col("_match")).otherwise(_written(F.col("kind"), F.col("_match"), F.col("stand_in"), F.col("_given")))
    # Matches without given names are dealt by their rows, not to the one task of the null key.
    one = one.withColumn("_person", F.coalesce("_person", F.concat(F.lit("\u0003"), F.col("__row").cast("string"))))
    people = _people(F.col("kind"), F.col("_match"), F.col("stand_in"), F.col("_given"))
    spelled = one.join(known, ["kind", "canonical"], "left").join(given, "_person", "left").select("__row", "_at", said.alias("_new"), F.col("stand_in").isNotNull().cast("long").alias("_n"), people.alias("_who"))
    new = spelled.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("_at", "_new"))).alias("_by"), F.sum("_n").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_who")))).alias("_people"))
    done = rows.where(F.size("__found") > 0).join(new, "__row")
    people = F.filter("_people", lambda p: p["old"].contains(" ") | ~F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(p["old"]), F.lit(r"\E(?![\p{L}\p{N}])"))))
    done = done.withColumn("_people", F.when(F.size("_people") > 0, people).otherwise(F.col("_people")))
    pieces = F.zip_with(gaps, F.concat(F.col("_by._new"), F.array(F.lit(""))), lambda gap, said: F.concat(_named_again(gap, F.col("_people")), said))
    done = done.select(*(F.array_join(pieces, "").alias("text") if c == "text" else F.col(c) for c in keep), F.col("_n").alias("n_entities"))
    return rows.where(F.size("__found") == 0).select(*keep, F.lit(0).cast("long").alias("n_entities")).unionByName(done)
