"""Surrogates for personal data and secrets, with built-in functions only.

Entities are found by one pattern. Each has a type and a canonical form (an e-mail address
in lower case, a phone number without separators, ...), so spellings of one entity share one
surrogate throughout the corpus. A surrogate is derived from a keyed hash of type and
canonical form and keeps what the entity looks like: length, separators, case, digits for
digits, letters of the same script, valid octets, a card's first digit and check digit,
a phone's country code, a name's title and gender.

Surrogates are checked over the whole corpus: no two entities of a type may share one,
and none may be an entity of the corpus itself. The smallest canonical form keeps a
contested surrogate, the others draw again with the next attempt; what is still contested
after ``ATTEMPTS`` rounds takes a plain tag with 128 bits of the hash.

Only distinct entities are exchanged for this, and only texts that hold an entity are
joined with their surrogates; all other rows pass in the scan.

The value of a secret runs to its closing quote on the line, or else to white space, without
the punctuation that ends a sentence. After a colon and without quotes it has six characters
at least or one that is no letter, since prose has colons, too. E-mail domains have the 127
labels that a domain can have, IBANs the 34 characters of the standard; a name is its title
and up to three capitalised words, and none without a title is found.

Defined cases: null and empty texts stay as they are; texts without entities are returned
byte for byte; all other columns are kept; repeated rows give repeated results; rows
without an id are treated like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.base import fresh, stored

KEY = "tokenmill"
ATTEMPTS = 12

# Titles that show a name and its gender.
TITLES_M = ("Mr", "Mister", "Herr", "Herrn", "Señor", "Monsieur", "Господин", "Κύριος")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Mme", "Госпожа", "Κυρία")
# Letters that surrogate names and words are made of, by script.
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "abcdefghijklmnopqrstuvwxyz"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "абвгдежзиклмнопрстуфхцчшщэюя"),
    "greek": ("βγδζκλμνπρστφ", "αειου", "αβγδεζηθικλμνξοπρστυφχψω"),
}
# A secret's value up to its closing quote, or up to white space; after a bare colon it must look like one.
_QUOTED = r"""(?:"(?!")[^\r\n]+?(?<!\\)(?=")|'(?!')[^\r\n]+?(?<!\\)(?='(?!\p{L})))"""
_BARE = r"""\S*[^\s.,;:!?"'()\[\]{}<>]"""
_TELLING = r"""(?=\S{6}|\p{L}{0,5}[^\p{L}\s.,;:!?"'()\[\]{}<>])"""
_SIGN = r"\s*+[=:]{1,3}+>?+\s*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type and pattern, in order of preference at one place of a text.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}",
    "secret": rf"""(?i:password|passwd|pwd|secret|token|api_?key)["']?+{_SIGN}(?:{_QUOTED}|["']?+(?:(?<=[="'])|(?<==\s)|{_TELLING}){_BARE})""",
    "aws": r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![.-])(?:\d{4}[ -]?){3}\d{1,7}(?![\p{L}\d])",
    "name": rf"(?:{'|'.join(TITLES_M + TITLES_F)})\.? \p{{Lu}}[\p{{L}}'’-]++(?: \p{{Lu}}[\p{{L}}'’-]++){{0,2}}",
}
#: What stands before the value of a secret.
SECRET_LEAD = rf"""^[\p{{L}}_]+["']?+{_SIGN}["']?+"""
#: Entities begin where no word goes on, so most places of a text fail at one look back.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type(raw: str = "raw") -> Column:
    """The type of an entity, from its own shape."""
    whole = lambda p: f"{raw} RLIKE {_lit('^(?:' + p + ')$')}"
    order = ("email", "aws", "ip", "iban", "phone", "ssn", "card")
    return F.expr("CASE " + " ".join(f"WHEN {whole(PATTERNS[t])} THEN '{t}'" for t in order) + f" WHEN {raw} RLIKE {_lit('^(?:' + '|'.join(TITLES_M) + ')[.]? ')} THEN 'name_m' WHEN {raw} RLIKE {_lit('^(?:' + '|'.join(TITLES_F) + ')[.]? ')} THEN 'name_f' ELSE 'secret' END")


def _canonical() -> Column:
    return F.expr(
        r"""CASE WHEN type = 'email' THEN lower(raw)
            WHEN type IN ('phone', 'ssn', 'card') THEN regexp_replace(raw, '[^0-9+]', '')
            WHEN type = 'iban' THEN replace(raw, ' ', '')
            WHEN type IN ('name_m', 'name_f') THEN lower(regexp_replace(raw, '^[^ ]+ ', ''))
            WHEN type = 'secret' THEN regexp_replace(raw, """
        + _lit(SECRET_LEAD)
        + """, '')
            ELSE raw END"""
    )


def _bytes(what: str, n: str) -> str:
    """Keyed hashes as hex, enough for ``n`` values of 4 digits, 32 in each."""
    return f"transform(sequence(0, ({n}) DIV 32), b -> sha2(concat_ws('|', key, type, {what}, attempt, b), 512))"



def _value(hex_: str, i: str) -> str:
    return f"CAST(conv(substr({hex_}[CAST(({i}) DIV 32 AS INT)], 4 * (({i}) % 32) + 1, 4), 16, 10) AS INT)"


def _pick(letters: str, v: str) -> str:
    return f"substr('{letters}', {v} % {len(letters)} + 1, 1)"


def _drawn(c: str, v: str) -> str:
    """A character like ``c``, chosen by the number ``v``."""
    (_, _, latin), (_, _, cyrillic), (_, _, greek) = SCRIPTS.values()
    return f"""CASE WHEN {c} BETWEEN '0' AND '9' THEN CAST({v} % 10 AS STRING)
        WHEN {c} BETWEEN 'a' AND 'z' THEN IF(hexadecimal, {_pick('abcdef', v)}, {_pick(latin, v)})
        WHEN {c} BETWEEN 'A' AND 'Z' THEN upper(IF(hexadecimal, {_pick('abcdef', v)}, {_pick(latin, v)}))
        WHEN {c} RLIKE '^\\\\p{{IsCyrillic}}$' THEN IF({c} = lower({c}), {_pick(cyrillic, v)}, upper({_pick(cyrillic, v)}))
        WHEN {c} RLIKE '^\\\\p{{IsGreek}}$' THEN IF({c} = lower({c}), {_pick(greek, v)}, upper({_pick(greek, v)}))
        WHEN {c} RLIKE '^\\\\p{{L}}$' THEN IF({c} = lower({c}), {_pick(latin, v)}, upper({_pick(latin, v)}))
        ELSE {c} END"""


def _luhn(digits: str) -> str:
    """Luhn sum of a string of digits, its last one counting once."""
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT)
        WHEN CAST(substr({digits}, i, 1) AS INT) < 5 THEN 2 * CAST(substr({digits}, i, 1) AS INT) ELSE 2 * CAST(substr({digits}, i, 1) AS INT) - 9 END)"""


def _name_word(script: str) -> str:
    """Three to six syllables from the hash of one word, with a gendered end for a given name."""
    consonants, vowels, _ = SCRIPTS[script]
    v = lambda i: f"CAST(conv(substr(sha2(concat_ws('|', key, 'name', w, attempt), 256), {4 * i + 1}, 4), 16, 10) AS INT)"
    syllable = "||".join(_pick(consonants, v(2 * i)) + "||" + _pick(vowels, v(2 * i + 1)) for i in range(3 + (ATTEMPTS - 1) // 3))
    ends = {"latin": ("na", "n"), "cyrillic": ("на", "н"), "greek": ("να", "ν")}[script]
    # later attempts take longer names, so that a corpus with very many names finds free ones
    return f"substr({syllable}, 1, 6 + 2 * (attempt DIV 3)) || CASE WHEN i = size(split(canon, ' ')) - 1 THEN '' WHEN type = 'name_f' THEN '{ends[0]}' ELSE '{ends[1]}' END"


def _core() -> dict[str, str]:
    """Expressions for the surrogate of a canonical form. They need key, type, canon and attempt."""
    fixed = """CASE type WHEN 'phone' THEN IF(canon LIKE '+1%' OR canon LIKE '+7%', 2, IF(canon LIKE '+%', 3, 0)) WHEN 'card' THEN 1 WHEN 'aws' THEN 4 WHEN 'iban' THEN 2 ELSE 0 END"""
    upto = "IF(type = 'email', length(canon) - length(substring_index(canon, '.', -1)), length(canon))"
    chars = f"""array_join(transform(split(canon, ''), (c, i) -> IF(i < fixed OR i >= upto, c, {_drawn('c', _value('hex', '(i + 1)'))})), '')"""
    octets = f"""array_join(transform(split(canon, '[.]'), (o, i) -> CAST(CASE length(o) WHEN 1 THEN {_value('hex', 'i')} % 10 WHEN 2 THEN 10 + {_value('hex', 'i')} % 90 ELSE 100 + {_value('hex', 'i')} % 156 END AS STRING)), '.')"""
    checked = f"""IF({_luhn('canon')} % 10 = 0, substr(drawn, 1, length(drawn) - 1) || CAST((10 - ({_luhn("(substr(drawn, 1, length(drawn) - 1) || '0')")}) % 10) % 10 AS STRING), drawn)"""
    words = f"""array_join(transform(split(canon, ' '), (w, i) -> CASE WHEN w RLIKE '\\\\p{{IsCyrillic}}' THEN {_name_word('cyrillic')} WHEN w RLIKE '\\\\p{{IsGreek}}' THEN {_name_word('greek')} ELSE {_name_word('latin')} END), ' ')"""
    return {"fixed": fixed, "upto": upto, "hexadecimal": "type = 'secret' AND canon RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$'", "hex": _bytes("canon", "length(canon) + 1"), "drawn": chars, "octets": octets, "checked": checked, "words": words}


def draw(entities: DataFrame, attempt: int, key: str = KEY) -> DataFrame:
    """Adds ``core``, the surrogate of each ``type, canon`` at this attempt."""
    e = _core()
    t = entities.select("type", "canon", F.lit(key).alias("key"), F.lit(attempt).alias("attempt"))
    t = t.selectExpr("*", *(f"{e[c]} AS {c}" for c in ("fixed", "upto", "hexadecimal", "hex")))
    t = t.selectExpr("*", f"CASE WHEN type = 'ip' THEN {e['octets']} WHEN type IN ('name_m', 'name_f') THEN {e['words']} ELSE {e['drawn']} END AS drawn")
    return t.selectExpr("type", "canon", f"CASE WHEN type = 'card' THEN {e['checked']} ELSE drawn END AS core")


def surrogates(entities: DataFrame, key: str = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """``type, canon, core``: distinct entities with distinct surrogates that are no entities themselves."""
    left = entities.select("type", "canon").distinct()
    known = left.select("type", F.col("canon").alias("core"))
    taken = None
    for k in range(attempts):
        drawn = stored(draw(left, k, key), "drawn")
        first = drawn.groupBy("type", "core").agg(F.min("canon").alias("canon"))
        good = first.join(known, ["type", "core"], "left_anti")
        if taken is not None:
            good = good.join(taken, ["type", "core"], "left_anti")
        good = stored(good.select("type", "canon", "core"), "surrogates")
        taken = good if taken is None else taken.unionByName(good)
        left = drawn.select("type", "canon").join(good.select("type", "canon"), ["type", "canon"], "left_anti")
        if left.isEmpty():
            return taken
    tag = F.concat(F.lit("["), F.col("type"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), "type", "canon"), 256), 1, 32), F.lit("]"))
    return taken.unionByName(left.select("type", "canon", tag.alias("core")))


def _rendered() -> Column:
    """A surrogate in the spelling of the raw entity: its separators, its case, its title."""
    walk = """aggregate(transform(sequence(1, length(raw)), i -> substr(raw, i, 1)), named_struct('s', '', 'k', 1), (a, c) ->
        CASE WHEN c RLIKE '[0-9+]' THEN named_struct('s', a.s || substr(core, a.k, 1), 'k', a.k + 1) ELSE named_struct('s', a.s || c, 'k', a.k) END, a -> a.s)"""
    spaced = walk.replace("'[0-9+]'", "'[^ ]'")
    cased = "array_join(transform(sequence(1, length(raw)), i -> IF(substr(raw, i, 1) = lower(substr(raw, i, 1)), substr(core, i, 1), upper(substr(core, i, 1)))), '')"
    return F.expr(
        f"""CASE WHEN core LIKE '[%]' THEN core
            WHEN type IN ('phone', 'ssn', 'card') THEN {walk}
            WHEN type = 'iban' THEN {spaced}
            WHEN type = 'email' THEN {cased}
            WHEN type IN ('name_m', 'name_f') THEN regexp_extract(raw, '^[^ ]+ ', 0) || IF(regexp_replace(raw, '^[^ ]+ ', '') = upper(regexp_replace(raw, '^[^ ]+ ', '')), upper(core), initcap(core))
            WHEN type = 'secret' THEN regexp_extract(raw, {_lit(SECRET_LEAD)}, 0) || core
            ELSE core END"""
    )


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, raw, type, canon``: the distinct spellings that each document holds."""
    held = docs.where(F.col(text).rlike(PATTERN)).select(F.col(doc_id).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))).alias("raw"))
    return held.distinct().withColumn("type", _type()).withColumn("canon", _canonical())


def pseudonymise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = KEY, found: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the texts; all columns are kept. ``found`` adds an array of the types replaced, in order."""
    found_, map_, id_ = fresh(docs.columns, "found_types"), fresh(docs.columns, "surrogate_of"), fresh(docs.columns, "surrogate_id")
    has = F.coalesce(F.col(text).rlike(PATTERN), F.lit(False))
    held = stored(occurrences(docs, doc_id, text), "entities")
    raws = held.select("raw", "type", "canon").distinct()
    spelt = stored(raws.join(surrogates(raws, key), ["type", "canon"]).select("raw", "type", _rendered().alias("new")), "spellings")
    # one map per document id: the spellings it holds, so no larger than its texts
    maps = held.select(F.col("id").alias(id_), "raw").join(spelt, "raw").groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("raw", F.struct("new", "type")))).alias(map_))
    t = docs.where(has).join(maps, F.col(doc_id).eqNullSafe(F.col(id_)))
    raw = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    between = F.split(F.col(text), PATTERN, -1)
    new = F.transform(raw, lambda r: F.col(map_)[r]["new"])
    # a text is what stands between its entities with their surrogates in turn
    rebuilt = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    columns = lambda extra, changed: [*(changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), *([extra.alias(found)] if found else [])]
    hit = t.withColumn(found_, F.transform(raw, lambda r: F.col(map_)[r]["type"])).select(*columns(F.col(found_), rebuilt))
    clean = docs.where(~has).select(*columns(F.array().cast("array<string>"), F.col(f"`{text}`")))
    return clean.unionByName(hit)
