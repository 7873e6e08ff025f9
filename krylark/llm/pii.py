"""Surrogates for personal data, as DataFrame expressions only.

Detection is one regular expression, and in texts with names a second one that also has their family names alone; the
text is split at the matches and put together again with surrogates.  A surrogate is a keyed permutation that keeps the
format: the first character moves within its class (digit, upper or lower case letter of a script, vowel or consonant
in names) by a nonzero number of places that a keyed SHA-256 of the rest tells, and the rest goes through a Feistel
network whose halves move each other's characters by bytes of a keyed SHA-512.  So no entity is its own surrogate,
different entities have different surrogates, and an entity has the same one in every document, with no table of
entities to shuffle.  Listed given names turn within the list of their gender and script.  A surrogate that is also an
entity of the same document is drawn again under another key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Given names by gender and script, with no name in two lists.
GIVEN = {
    "female_latin": ["Anna", "Maria", "Emma", "Julia", "Laura", "Sarah", "Sophie", "Claire", "Emily", "Alice", "Ingrid", "Carmen", "Lucía", "Chloé", "Hannah", "Olivia", "Mary", "Jane", "Susan", "Linda"],
    "male_latin": ["John", "Peter", "Thomas", "Michael", "David", "James", "Robert", "William", "Carlos", "Miguel", "Pierre", "Jean", "Hans", "Klaus", "Stefan", "Paul", "Mark", "George", "Daniel", "Henry"],
    "female_cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
    "male_cyrillic": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай"],
}
#: Titles before a family name.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "г-н", "г-жа"]
#: What stands before or after a name of two or more words, and small words within it.
BEFORE_NAME = ["name is", "Name is", "I am", "I'm", "Ich heiße", "ich heiße", "Me llamo", "me llamo", "m'appelle", "Меня зовут", "меня зовут", "Dear", "Signed", "signed", "said", "says", "wrote", "sagte", "dijo"]
BEFORE_NAME += [x + ":" for x in ("name", "Name", "author", "Author", "contact", "Contact", "customer", "Customer", "patient", "Patient", "employee", "Employee", "From", "To", "Attn", "Kontakt", "Autor", "Nombre", "Nom", "Имя")]
AFTER_NAME = ["said", "says", "wrote", "writes", "told", "asked", "replied", "sagte", "schrieb", "dijo", "escribió", "déclare", "сказал", "сказала"]
#: Words that begin sentences and are no names.
STARTERS = ["The", "Then", "When", "While", "And", "But", "Or", "So", "If", "As", "In", "On", "At", "For", "From", "After", "Before", "Yesterday", "Today", "Now", "Later", "Here", "There", "This", "That", "Der", "Die", "Das", "Dann", "Und", "Aber", "El", "La", "Los", "Las", "Pero", "Le", "Les", "Puis", "Mais", "Et"]
PARTICLES = ["de", "da", "di", "del", "della", "dos", "van", "von", "der", "den", "la", "le", "bin", "al", "el"]

# Letters that surrogates are made of: Latin with its accented letters, Greek and Cyrillic.
_WIDE = [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x460)) if chr(c).isupper() or chr(c).islower()]
_VOWELS, _SIGNS = "aeiouаеиоуыэюяёαεηιουω", "ъьЪЬ"


def _classes(name: bool, hexadecimal: bool = False) -> list[str]:
    """Characters that move among each other, as disjoint strings."""
    digits, small, capital = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if hexadecimal:
        return [digits, small[:6], capital[:6]]
    groups: dict[tuple, list[str]] = {}
    for c in [*digits, *small, *capital, *_WIDE]:
        script = "digit" if c.isdigit() else "plain" if c < "\x7f" else "latin" if c < "ƀ" else "wide latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic"
        basic = c.lower() in "абвгдежзийклмнопрстуфхцчшщъыьэюяё" or c.lower() in "αβγδεζηθικλμνξοπρστυφχψω"
        groups.setdefault((script, c.isupper(), basic, name and c.lower() in _VOWELS, name and c in _SIGNS), []).append(c)
    return ["".join(g) for g in groups.values() if len(g) > 1]


_MOVES = "".join(x for g in _classes(False) for x in g)
# (ranges, as a long list of characters makes a slow test)
_WIDE_RANGE = r"\u00C0-\u024F\u0370-\u045F"
_LETTER = "A-Za-z" + _WIDE_RANGE
_UPPER = rf"(?:[A-Z]|(?=[{_WIDE_RANGE}])\p{{Lu}})"
_NAME = rf"{_UPPER}[{_LETTER}'’]+(?:-{_UPPER}[{_LETTER}]+)?"
_FULL = rf"(?!(?:{'|'.join(STARTERS)}) ){_NAME}(?: (?:{'|'.join(PARTICLES)})){{0,3}} {_NAME}(?: {_NAME})?"
_GIVEN_ANY = "|".join(x for names in GIVEN.values() for x in names)
# two capitalized words in a row, small words between them: looked at before any pattern of a name is tried
_TWO = rf"{_UPPER}[{_LETTER}'’-]*\.? (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_UPPER}"
_CAPITAL = "|".join(t for t in TITLES if t[0].isupper())
_SMALL = "|".join(t for t in TITLES if t[0].islower())
_NAMED = "|".join([
    rf"(?:{_CAPITAL})\.? (?:{_NAME} ){{0,2}}{_NAME}(?!\w)",
    rf"(?:{_GIVEN_ANY})(?: (?:{'|'.join(PARTICLES)})){{0,3}}(?: {_NAME}){{1,2}}(?!\w)",
    rf"(?<=(?<!\w)(?:{'|'.join(BEFORE_NAME)}) ){_FULL}(?!\w)",
    rf"{_FULL}(?= (?:{'|'.join(AFTER_NAME)})(?!\w)|,? [<(]?[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9])",
])
#: Kind of entity and its pattern; the first that fits at a place counts.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.){1,30}[A-Za-z]{2,24}(?![\w-])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,5}(?::[0-9A-Fa-f]{1,4}){1,4})(?![\w:])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w+.,-])0\d{2,4} \d{3,4} \d{3,4}(?![\w-]| \d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "access_key": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "secret": r"(?i:(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:\s*[=:]\s*[\"']?)[^\s\"',;]{8,})",
    "name": rf"(?={_UPPER})(?<!\w)(?={_TWO})(?:{_NAMED})|(?=г-)(?<!\w)(?:{_SMALL}) (?:{_NAME} ){{0,2}}{_NAME}(?!\w)",
}
#: What a match of a kind begins with, looked at before its pattern is tried.
BEGINS = {"email": r"[A-Za-z0-9](?<![\w.+-].)[A-Za-z0-9._%+-]*+@", "ipv4": r"\d", "ipv6": r"[0-9A-Fa-f]{1,4}:", "phone": r"[+(\d]", "ssn": r"\d", "card": r"\d", "iban": r"[A-Z][A-Z]\d", "access_key": "AKIA", "secret": r"[pPsStTaA]"}
#: All kinds but names, and all kinds.
PLAIN_PATTERN = "|".join(f"(?={BEGINS[k]})(?:{p})" for k, p in PATTERNS.items() if k != "name")
PATTERN = f"{PLAIN_PATTERN}|(?:{PATTERNS['name']})"
#: How card numbers of the issuers begin.
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[68]|352[89]|35[3-8]|6011|62|64[4-9]|65)"
#: A document without any of these has no entity but names; the cheap test spares most texts the patterns.
HINT = r"@|\d\d|\d\.\d+\.\d|AKIA|:[0-9A-Fa-f]{0,4}:|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
SECRET_LEAD = r"^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:\s*[=:]\s*[\"']?))?"
#: An even number of rounds leaves the halves in their places.
ROUNDS = 4
#: Family names of at least so many letters are also looked for alone, in a text that has them with a given name or a title.
LEAST_FAMILY = 3


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(digest: str, digits: int = 6) -> str:
    return f"cast(conv(substr({digest}, 1, {digits}), 16, 10) as bigint)"


def _shift(c: str, k: str, mode: str, never_zero: bool) -> str:
    """SQL: character ``c`` moved ``k`` places within its class, by at least one if ``never_zero``; what is in no class stays."""

    def chain(classes: list[str]) -> str:
        step = lambda n: f"1 + {k} % {n - 1}" if never_zero else k
        return "case " + " ".join(f"when instr('{x}', {c}) > 0 then substr('{x}', cast((instr('{x}', {c}) - 1 + {step(len(x))}) % {len(x)} as int) + 1, 1)" for x in classes) + f" else {c} end"

    return f"case {mode} when 'name' then {chain(_classes(True))} when 'hex' then {chain(_classes(False, True))} else {chain(_classes(False))} end"


def _permuted(e: str, key: str, tweak: str, mode: str) -> str:
    """SQL: the keyed permutation of string ``e`` that keeps the class of every character and moves the first that has one."""
    parts = ", ".join(f"'{n}', regexp_extract({e}, {_q(f'(?s)^([^{_MOVES}]*)([{_MOVES}])(.*)$')}, {g})" for n, g in (("a", 1), ("c", 2), ("z", 3)))
    byte = "cast(conv(substr(d, (j % 64) * 2 + 1, 2), 16, 10) as int)"
    step = _let("d", f"sha2(concat_ws('|', {_q(key)}, {tweak}, f, i, s.r), 512)", f"named_struct('l', s.r, 'r', array_join(transform(regexp_extract_all(s.l, '(?s).', 0), (x, j) -> {_shift('x', byte, mode, False)}), ''))")
    rest = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr(p.z, 1, length(p.z) div 2), 'r', substr(p.z, length(p.z) div 2 + 1)), (s, i) -> {step}, s -> concat(s.l, s.r))"
    first = _shift("p.c", "h", mode, True)
    moved = _let("p", f"named_struct({parts})", _let("h", _number(f"sha2(concat_ws('|', {_q(key)}, {tweak}, 'first', p.z), 256)"), _let("f", first, f"concat(p.a, f, {rest})")))
    return f"if({e} rlike {_q(f'[{_MOVES}]')}, {moved}, {e})"


def _luhn(digits: str, odd: int) -> str:
    """SQL: the Luhn sum of a string's digits; ``odd`` says which place from the right is doubled (0: the last)."""
    d = "cast(x as int)"
    return f"aggregate(transform(reverse(regexp_extract_all({digits}, '[0-9]', 0)), (x, n) -> if(n % 2 = {odd}, {d} * 2 - if({d} > 4, 9, 0), {d})), 0, (a, b) -> a + b)"


def _mod97(e: str) -> str:
    """SQL: an IBAN's rest by 97 after its first four characters went to the end."""
    compact = f"replace({e}, ' ', '')"
    return f"aggregate(regexp_extract_all(concat(substr({compact}, 5), substr({compact}, 1, 4)), '[0-9A-Z]', 0), 0, (a, c) -> if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(map(_q, values)) + ")"


def _turned(word: str, key: str) -> str:
    """SQL: a listed given name turned within its list by a keyed, nonzero number of places; null for other words."""
    out = "case "
    for label, names in GIVEN.items():
        turn = f"{_number(f'sha2({_q(key + chr(124) + label)}, 256)')} % {len(names) - 1} + 1"
        out += f"when array_contains({_array(names)}, {word}) then element_at({_array(names)}, cast((array_position({_array(names)}, {word}) - 1 + {turn}) % {len(names)} as int) + 1) "
    return out + "end"


def kind_sql(m: str) -> str:
    """SQL: the kind of a match, null where its check digits or its beginning say that it is none."""
    valid = {"card": f"and {_luhn(m, 1)} % 10 = 0 and {m} rlike {_q(ISSUERS)}", "iban": f"and {_mod97(m)} = 1", "secret": f"and regexp_replace({m}, {_q(SECRET_LEAD)}, '') rlike {_q(f'[{_MOVES}]')}"}
    whole = {k: p for k, p in PATTERNS.items() if k != "name"} | {"name": rf"(?:(?:{'|'.join(TITLES)})\.? )?[{_LETTER}'’ -]+"}
    return "case " + " ".join(f"when {m} rlike {_q('^(?:' + p + ')$')} {valid.get(kind, '')} then '{kind}'" for kind, p in whole.items()) + " end"


def surrogate_sql(kind: str, m: str, key: str) -> str:
    """SQL: the surrogate of match ``m`` of kind ``kind``; a match without a kind stays as it is.

    An entity is cut into segments: a part that stays, a body that is permuted, and the body's tweak and mode.
    """

    def segment(keep: str = "''", body: str = "''", tweak: str = "''", mode: str = "'plain'") -> str:
        return f"named_struct('keep', {keep}, 'body', {body}, 'tweak', {tweak}, 'mode', {mode})"

    at = f"instr({m}, '@')"
    domain = f"substr({m}, {at} + 1)"
    head, last = f"regexp_extract({domain}, '^(.*)[.]([^.]+)$', 1)", f"regexp_extract({domain}, '^(.*)[.]([^.]+)$', 2)"
    code = f"regexp_extract({m}, '^([+][0-9]{{1,3}}[ .-]?|0)?', 0)"
    lead = f"regexp_extract({m}, {_q(SECRET_LEAD)}, 0)"
    value = f"substr({m}, length({lead}) + 1)"
    titles = _array([t + dot for t in TITLES for dot in ("", ".")])
    space = "if(n > 0, ' ', '')"
    token = (
        f"case when n = 0 and array_contains({titles}, w) or w rlike '^[a-zа-яα-ω]' then {segment(f'concat({space}, w)')} "
        f"when n = size(t) - 1 then {segment(space, 'w', _q('family'), _q('name'))} "
        f"when {_turned('w', key)} is not null then {segment(f'concat({space}, {_turned(chr(119), key)})')} "
        f"else {segment(space, 'w', _q('given'), _q('name'))} end"
    )
    segments = {
        "email": f"array({segment(body=f'substr({m}, 1, {at} - 1)', tweak=f'concat({_q("local:")}, {domain})')}, {segment(_q('@'), head, _q('domain'))}, {segment(f'concat({_q(".")}, {last})')})",
        "ipv6": f"array({segment(body=m, tweak=_q('ipv6'), mode=_q('hex'))})",
        "phone": f"array({segment(code, f'substr({m}, length({code}) + 1)', _q('phone'))})",
        "ssn": f"array({segment(body=m, tweak=_q('ssn'))})",
        "card": f"array({segment(f'substr({m}, 1, 4)', f'substr({m}, 5, length({m}) - 5)', f'concat({_q("card")}, substr({m}, 1, 4))')})",
        "iban": f"array({segment(f'concat(substr({m}, 1, 2), {_q("00")})', f'substr({m}, 5)', _q('iban'))})",
        "access_key": f"array({segment(f'substr({m}, 1, 4)', f'substr({m}, 5)', _q('access_key'))})",
        "secret": f"array({segment(lead, value, _q('secret'), f'if({value} rlike {_q("^[0-9a-f]+$")}, {_q("hex")}, {_q("plain")})')})",
        "name": _let("t", f"split({m}, ' ')", f"transform(t, (w, n) -> {token})"),
    }
    cut = f"case {kind} " + " ".join(f"when '{k}' then {v}" for k, v in segments.items()) + " end"
    every = _array([x for names in GIVEN.values() for x in names])
    # what is not in a list must not become a listed name: go on along the permutation until it is none
    body = _let("y", _permuted("g.body", key, "g.tweak", "g.mode"), f"if(g.tweak = 'given' and array_contains({every}, y), {_permuted('y', key, 'g.tweak', 'g.mode')}, y)")
    joined = f"array_join(transform({cut}, g -> concat(g.keep, {body})), '')"
    checked = _let("o", joined, f"case {kind} when 'card' then concat(o, cast((10 - {_luhn('o', 0)} % 10) % 10 as string)) when 'iban' then concat(substr(o, 1, 2), lpad(cast(98 - {_mod97('o')} as string), 2, '0'), substr(o, 5)) else o end")

    hash12 = lambda x: _number(f"sha2(concat_ws('|', {_q(key)}, 'ipv4', {x}), 256)", 3)
    high = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v.hi div 4096, 'r', v.hi % 4096), (s, i) -> named_struct('l', s.r, 'r', s.l ^ {hash12('u, i, s.r')}), s -> s.l * 4096 + s.r)"
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ipv4 = _let("q", octets, _let("v", "named_struct('hi', q[0] * 65536 + q[1] * 256 + q[2], 'lo', q[3])", _let("u", f"(v.lo + 1 + {hash12(chr(118) + '.hi')} % 255) % 256", _let("z", high, "concat_ws('.', z div 65536, z div 256 % 256, z % 256, u)"))))
    return f"case when {kind} is null then {m} when {kind} = 'ipv4' then {ipv4} else {checked} end"


#: SQL of what ``replace_entities`` adds, over the matches.
_REPORT = {
    "n_entities": "cast(size(_real) as bigint)",
    "entity_kinds": "array_sort(array_distinct(transform(_real, f -> f.kind)))",
    "n_collisions": "cast(size(array_distinct(transform(_real, f -> f.entity))) - size(array_distinct(transform(_real, f -> f.surrogate))) + size(array_intersect(transform(_real, f -> f.entity), transform(_real, f -> f.surrogate))) as bigint)",
}


def _with_surrogates(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """The whole row as a struct ``_row``, and beside it _text, _pattern and _found, the matches in order: (entity, kind, surrogate)."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    kinds = lambda matches: f"transform({matches}, m -> named_struct('entity', m, 'kind', {kind_sql('m')}))"
    extract = lambda pattern: f"regexp_extract_all(_text, {pattern}, 0)"
    df = df.withColumn("_named", F.expr(f"coalesce(_text rlike {_q(PATTERNS['name'])}, false)"))
    first = f"case when _named then {extract(_q(PATTERN))} when _text rlike {_q(HINT)} then {extract(_q(PLAIN_PATTERN))} else array() end"
    df = df.withColumn("_found", F.expr(f"coalesce({kinds(first)}, array())"))
    family = f"array_distinct(filter(transform(filter(_found, f -> f.kind = 'name'), f -> element_at(split(f.entity, ' '), -1)), w -> length(w) >= {LEAST_FAMILY}))"
    df = df.withColumn("_family", F.expr(family))
    df = df.withColumn("_pattern", F.expr(f"case when size(_family) > 0 then concat({_q(PATTERN)}, '|(?<!\\w)(?:', array_join(_family, '|'), ')(?!\\w)') when _named then {_q(PATTERN)} else {_q(PLAIN_PATTERN)} end"))
    df = df.withColumn("_found", F.expr(f"if(size(_family) > 0, {kinds(extract('_pattern'))}, _found)"))
    again = f"if(array_contains(transform(_found, x -> x.entity), s), {surrogate_sql('f.kind', 'f.entity', key + '|again')}, s)"
    made = _let("s", surrogate_sql("f.kind", "f.entity", key), f"if(f.kind is null, s, {again})")
    return df.withColumn("_found", F.expr(f"transform(_found, f -> named_struct('entity', f.entity, 'kind', f.kind, 'surrogate', {made}))"))


_JOINED = _let("p", "split(_text, _pattern, -1)", "concat(p[0], array_join(transform(_found, (f, i) -> concat(f.surrogate, p[i + 1])), ''))")


def _replaced(df: DataFrame, columns: list[str], text_col: str) -> list:
    text = F.expr(f"if(size(_found) > 0, {_JOINED}, _text)")
    return [text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns]


def replace_text(docs: DataFrame, text_col: str = "text", key: str = "krylark") -> DataFrame:
    """``docs`` with its text replaced and every other column, whatever its name, as it was.

    A null text stays null; a text without entities, empty ones among them, comes back unchanged; texts of any length
    are read whole; repeated rows come back alike; an empty table gives an empty one.
    """
    df = _with_surrogates(docs, text_col, key)
    return df.select(*_replaced(df, docs.columns, text_col))


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "krylark") -> DataFrame:
    """``docs`` with its text replaced, and n_entities, entity_kinds and n_collisions beside it.

    Every column of ``docs`` stays, but for columns with the three new names, which the new ones replace
    (``replace_text`` adds nothing).  A null text stays null, with no entities; a text without entities comes back unchanged.
    ``n_collisions`` counts, within a document, entities that lost their distinctness and surrogates that are also
    entities, after such a surrogate was drawn again; ``collision_report`` makes the same check over a whole table.
    """
    df = _with_surrogates(docs, text_col, key)
    keep = [c for c in docs.columns if c not in _REPORT]
    df = df.withColumn("_real", F.expr("filter(_found, f -> f.kind is not null)"))
    return df.select(*_replaced(df, keep, text_col), *[F.expr(x).alias(n) for n, x in _REPORT.items()])


def collision_report(docs: DataFrame, text_col: str = "text", key: str = "krylark") -> DataFrame:
    """Per kind over the whole table: distinct entities, distinct surrogates, and surrogates that are also entities."""
    pairs = _with_surrogates(docs.select(text_col), text_col, key).select(F.explode("_found").alias("f")).select("f.*").where("kind is not null").distinct()
    both = pairs.select("kind", F.col("entity").alias("value"), F.lit(1).alias("e"), F.lit(0).alias("s")).union(pairs.select("kind", "surrogate", F.lit(0), F.lit(1)))
    per = both.groupBy("kind", "value").agg(F.max("e").alias("e"), F.max("s").alias("s"))
    return per.groupBy("kind").agg(F.sum("e").alias("entities"), F.sum("s").alias("surrogates"), F.sum(F.col("e") * F.col("s")).alias("also_entities"))
