"""Personal data replaced by keyed surrogates.

Entities are found by one pattern; each belongs to a type. An entity has a canonical value
(digits of a phone number, an address in lower case, a name part), so that different ways of
writing it are one entity. Each distinct entity of the corpus gets one surrogate of the same
type, and every place it is written at gets the surrogate in the place's own format: separators,
letter case, script and, for names, gender stay.

A surrogate is a keyed permutation of the entity's own format: each digit and letter moves
within its alphabet, by Feistel rounds in which one half of the value moves the other. So all values of
one format have different surrogates, also where a format is used up, as by one-letter addresses. Names
are syllables drawn by a keyed hash. A surrogate that another entity has, or that is itself an entity
of the corpus, is made anew under the next key, ATTEMPTS times in all. What is left then gets a
longer value: its permuted form, an end mark and filling up to more characters than any entity of the type has, which is
distinct from all others and no entity. So the work ends after a fixed number of rounds.

Everything is DataFrame work. All texts are written once, with the entities found in them. Texts with entities are
shuffled once; others not at all.
Occurrences of a hot entity are spread over many documents, and their join with the surrogates
may be split by adaptive execution.

Defined results: null and empty texts stay as they are, with 0 entities; repeated rows get
the same text; documents keep all columns (``_at``, ``_found``, ``_names``, ``_pattern``, ``_new`` are reserved); an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.session import stage

KEY = "surrogate-key-1"
# Keys under which a surrogate is sought before it is made longer.
ATTEMPTS = 3

_WORD_START = r"(?<![\p{L}\p{N}._%+\-@])"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Sr|Sra|Mme|Dr|Prof)\b\.?|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Господин|Госпожа)"
_TITLES = rf"(?:{_TITLE}\s+)+"
# A name part: initials before it, small words of a family name, inner capitals, apostrophes and hyphens belong to it.
_PART = (
    rf"(?!{_TITLE}\s)(?:\p{{Lu}}\.\s?)*(?:(?:van|von|der|den|de|del|della|di|da|dos|la|le|bin|al)[^\S\n]+){{0,3}}"
    r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:['’\-]\p{L}{2,})*"
)
#: Type and pattern; where two begin at the same place, the first wins.
TYPES = {
    "email": _WORD_START + r"[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": (
        r"(?<![\p{L}\d])(?:\+\d{1,3}[ .\-]?)?\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
        r"|(?<![\p{L}\d+])\+1[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
        # A blank is not followed by an address or the groups of a card.
        r"|(?<![\p{L}\d+])\+[1-9](?:(?:[.\-/]| (?!(?:\d{1,3}\.){3}\d|(?:\d{4}[ \-]){3}\d)| ?\(|\)[ .\-/]?)?\d){6,14}(?!\d)"
        r"|(?<![\p{L}\d\-.])(?:1[ .\-])?(?:\d{3}-\d{3}-|\d{3}\.\d{3}\.|[2-9]\d{2} [2-9]\d{2}[ \-])\d{4}(?!\d|[\-.]\d)"
    ),
    "id": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?!\d)",
    "secret": (
        r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])"
        r"|(?<![\p{L}\p{N}_\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"
        r"|glpat-[A-Za-z0-9_\-]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}"
        r"|sk[-_](?:[a-z]{2,8}[-_])*[A-Za-z0-9_\-]{20,}|[rp]k_(?:live|test)_[A-Za-z0-9]{16,}"
        r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![\p{L}\p{N}_])"
        r"|(?<![A-Za-z0-9_+/\-])(?=[A-Za-z0-9_+/\-]{16})(?<=(?i:secret|token|passwd|password|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
        r"(?=[A-Za-z_+/\-]*\d)(?=[\d_+/\-]*[A-Za-z])[A-Za-z0-9_+/\-]{16,}+={0,2}"
    ),
    "person": rf"(?<!\p{{L}}){_TITLES}{_PART}(?:[^\S\n]+{_PART})*(?:\n{_PART}(?:[^\S\n]+{_PART})*)?(?!\p{{L}})",
}
FEMALE = r"^(?:Mrs|Ms|Miss|Sra|Mme|Frau|Madame|Señora|Госпожа)\b"
HEX = r"^[0-9a-fA-F]{32,}$"
#: A name part that may stand without a title.
MENTION = r"^\p{Lu}[\p{L}'’\-]+$"
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())

#: Syllables that surrogate names are made of, by script, and their endings.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ко ла ле ло ма ме мо на не но ра ре ро са се со та те то за".split(),
}
ENDINGS = {
    ("latin", "f"): "lina", ("latin", "m"): "ren", ("latin", "s"): "son",
    ("cyrillic", "f"): "лина", ("cyrillic", "m"): "рен", ("cyrillic", "s"): "сон",
}


def _code(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hex digits under the key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _pick(code: Column, place: Column | int) -> Column:
    """A number from 0 to 65535 from the code; places repeat after 31."""
    at = (place % 31) * 4 + 1 if isinstance(place, int) else (F.pmod(place, F.lit(31)) * 4 + 1).cast("int")
    return F.conv(F.substr(code, F.lit(at), F.lit(4)), 16, 10).cast("int")


#: First and last letter of the alphabets inside which letters move.
ALPHABETS = (
    "09 az AZ àö øÿ ÀÖ ØÞ ая АЯ ѐџ ЀЏ αω ΑΡ ΣΩ את بغ अह ぁゖ ァヺ 一鿿 가힣".split()
)
ROUNDS = 6
HEXDIGITS = "0123456789abcdef"


def _moved(ch: Column, by: Column) -> Column:
    """A digit or letter moved inside its alphabet; other letters inside 16 neighbouring code points."""
    at = F.ascii(ch)
    low, size = F, F
    for first, last in ALPHABETS:
        inside = at.between(ord(first), ord(last))
        low, size = low.when(inside, ord(first)), size.when(inside, ord(last) - ord(first) + 1)
    low, size = low.otherwise(at - at % 16), size.otherwise(16)
    to = low + (at - low + by) % size
    made = F.when(to < 128, F.char(to)).otherwise(F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32"))
    return F.when(ch.rlike(r"^[0-9\p{L}]$"), made).otherwise(ch)


def _moved_hex(ch: Column, by: Column) -> Column:
    return F.substr(F.lit(HEXDIGITS), (F.instr(F.lit(HEXDIGITS), ch) - 1 + by) % 16 + 1, F.lit(1))


def _permuted(value: Column, kind: Column, attempt: Column, key: str, moved=_moved) -> Column:
    """The value's image under a keyed permutation of all values of its format."""

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(part) / 32).cast("int"))
        secret = [F.lit(key), kind, attempt.cast("string"), turn.cast("string")]
        code = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", *secret, b.cast("string"), other), 512)), "")
        by = lambda k: F.conv(F.substr(code, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.array_join(F.transform(F.split(part, ""), lambda ch, k: moved(ch, by(k))), "")

    half = F.floor(F.length(value) / 2).cast("int")
    return F.aggregate(
        F.array(*map(F.lit, range(ROUNDS))),
        F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b")),
        lambda x, turn: F.struct(
            F.when(turn % 2 == 1, shifted(x["a"], x["b"], turn)).otherwise(x["a"]).alias("a"),
            F.when(turn % 2 == 0, shifted(x["b"], x["a"], turn)).otherwise(x["b"]).alias("b"),
        ),
        lambda x: F.concat(x["a"], x["b"]),
    )


def _octets(canon: Column, attempt: Column, key: str) -> Column:
    """A permutation of all addresses, octet by octet written as two hexadecimal digits."""
    packed = F.array_join(F.transform(F.split(canon, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")
    mixed = _permuted(packed, F.lit("ip"), attempt, key, _moved_hex)
    return F.concat_ws(".", *[F.conv(F.substr(mixed, F.lit(2 * k + 1), F.lit(2)), 16, 10) for k in range(4)])


def _luhn(digits: Column) -> Column:
    """Luhn remainder of a string of digits."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(
                (2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")
            ),
        ),
        F.lit(0),
        lambda a, b: a + b,
    ) % 10


def _name(code: Column, canon: Column) -> Column:
    """A name of the part's script; gender by the ending (f, m; s for a family name)."""
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    part = F.substr(canon, F.lit(1), F.lit(1))
    made = None
    for name, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        body = F.concat(*[F.element_at(table, _pick(code, k) % len(syllables) + 1) for k in range(5)])
        for gender in "fms":
            case = (script == name) & (part == gender)
            value = F.concat(F.lit(f"{gender}:"), body, F.lit(ENDINGS[name, gender]))
            made = F.when(case, value) if made is None else made.when(case, value)
    return made


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical value of the surrogate of an entity."""
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substr(_code(F.lit("host"), domain, F.lit(0), key), F.lit(1), F.lit(10))
    body = _permuted(F.substr(canon, F.lit(1), F.length(canon) - 1), kind, attempt, key)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return (
        F.when(kind == "ip", _octets(canon, attempt, key))
        .when(kind == "email", F.concat(_permuted(local, domain, attempt, key), F.lit("@h"), host, F.lit(".example.org")))
        .when((kind == "card") & (_luhn(canon) == 0), F.concat(body, check))
        .when((kind == "secret") & canon.rlike(HEX), _permuted(canon, kind, attempt, key, _moved_hex))
        .when(kind == "person", _name(_code(kind, canon, attempt, key), canon))
        .otherwise(_permuted(canon, kind, attempt, key))
    )


def longer_surrogate(kind: Column, canon: Column, longest: Column, key: str) -> Column:
    """A value with more characters than ``longest``, distinct for distinct entities of a type."""
    last = F.lit(ATTEMPTS)
    filled = lambda value, fill: F.concat(value, F.lit("1"), F.repeat(F.lit(fill), longest - F.length(value) + 1))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substr(_code(F.lit("host"), domain, F.lit(0), key), F.lit(1), F.lit(50))
    octets = F.concat(_octets(canon, last, key), F.lit(".1"), F.repeat(F.lit(".0"), longest))
    # A name: two syllables for each byte, and as many more as make it too long for a name of the corpus.
    code = _permuted(F.lower(F.hex(F.encode(F.substr(canon, F.lit(3)), "UTF-8"))), kind, last, key, _moved_hex)
    part = F.substr(canon, F.lit(1), F.lit(1))
    name = None
    for script, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables[:16]))
        coded = F.transform(F.split(code, ""), lambda ch: F.element_at(table, F.instr(F.lit(HEXDIGITS), ch)))  # noqa: B023
        body = F.concat(F.array_join(coded, ""), F.repeat(F.lit(syllables[-1]), longest))
        for gender in "fms":
            case = (canon.rlike(r"\p{IsCyrillic}") == (script == "cyrillic")) & (part == gender)
            value = F.concat(F.lit(f"{gender}:"), body, F.lit(ENDINGS[script, gender]))
            name = F.when(case, value) if name is None else name.when(case, value)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "email", F.concat(filled(_permuted(local, domain, last, key), "0"), F.lit("@h"), host, F.lit(".example.org")))
        .when(kind == "person", name)
        .otherwise(filled(_permuted(canon, kind, last, key), "0"))
    )


def kind_of(raw: Column) -> Column:
    """The first type whose pattern covers the whole entity.

    What is an entity by its surroundings alone is a name without a title, or a secret after its label.
    """
    made = F
    for name, pattern in TYPES.items():
        made = made.when(raw.rlike(f"^(?:{pattern})$"), name)
    return made.when(raw.rlike(MENTION), "person").otherwise("secret")


def person_parts(raw: Column) -> Column:
    """Canonical name parts of a titled person, the last one as the family name."""
    gender = F.when(raw.rlike(FEMALE), "f:").otherwise("m:")
    words = F.split(F.regexp_replace(raw, f"^{_TITLES}", ""), r"\s+")
    return F.transform(words, lambda w, k: F.concat(F.when(k == F.size(words) - 1, "s:").otherwise(gender), F.lower(w)))


def names_of(found: Column) -> Column:
    """(word, canon) of the name parts of titled persons, which stand for them elsewhere in the text.

    Words after a line end may begin a sentence, so they do not count; the halves of a double name do.
    """

    def of(raw: Column) -> Column:
        line = F.split(F.regexp_replace(raw, f"^{_TITLES}", ""), "\n")[0]
        words = F.split(F.trim(line), r"\s+")
        named = F.zip_with(words, F.slice(person_parts(raw), F.lit(1), F.size(words)), lambda w, c: F.struct(w.alias("word"), c.alias("canon")))
        halves = F.flatten(F.transform(
            F.filter(named, lambda n: n["word"].contains("-")),
            lambda n: F.transform(F.split(n["word"], "-"), lambda w: F.struct(w.alias("word"), F.concat(F.substr(n["canon"], F.lit(1), F.lit(2)), F.lower(w)).alias("canon"))),
        ))
        return F.filter(F.concat(named, halves), lambda n: n["word"].rlike(MENTION))

    return F.flatten(F.transform(F.filter(found, lambda raw: raw.rlike(f"^{_TITLES}")), of))


def pattern_with(names: Column) -> Column:
    """PATTERN, and the words of ``names`` (as they are or in capitals); longer words first."""
    words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n["word"], F.upper(n["word"])))))
    ordered = F.transform(
        F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), lambda x: x["w"]
    )
    mentions = F.concat(F.lit(r"|(?<![\p{L}\p{N}_@])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}_@])"))
    return F.when(F.size(names) > 0, F.concat(F.lit(PATTERN), mentions)).otherwise(F.lit(PATTERN))


def parts_of(kind: Column, raw: Column, names: Column) -> Column:
    """Canonical values that an entity stands for: name parts for a person, else one."""
    digits = F.regexp_replace(raw, r"\D", "")
    mentioned = F.filter(names, lambda n: F.lower(n["word"]) == F.lower(raw))
    person = F.when(raw.rlike(f"^{_TITLES}"), person_parts(raw)).otherwise(F.array(F.get(mentioned, F.lit(0))["canon"]))
    return (
        F.when(kind == "person", person)
        .when(kind.isin("phone", "card", "id"), F.array(digits))
        .when(kind == "iban", F.array(F.regexp_replace(raw, " ", "")))
        .when((kind == "secret") & ~raw.rlike(HEX), F.array(raw))
        .otherwise(F.array(F.lower(raw)))
    )


def written(kind: Column, raw: Column, found: Column) -> Column:
    """The surrogates ``found`` of an entity's parts, in the format of its place."""
    value = found[0]
    fill = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, ch: F.when(
            ch.rlike("^[A-Za-z0-9]$"),
            F.struct(F.concat(a["out"], F.substr(value, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(a["out"], ch).alias("out"), a["at"].alias("at"))),
        # What is longer than its place goes on behind it.
        lambda a: F.concat(a["out"], F.substr(value, a["at"])),
    )
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    title = F.regexp_extract(raw, f"^{_TITLES}", 0)
    names = F.array_join(F.transform(found, lambda x: F.initcap(F.substring_index(x, ":", -1))), " ")
    return (
        F.when(kind == "person", F.concat(title, F.when(upper, F.upper(names)).otherwise(names)))
        .when(kind.isin("phone", "card", "id", "iban"), fill)
        .otherwise(F.when(upper, F.upper(value)).otherwise(value))
    )


def surrogate_table(entities: DataFrame, key: str = KEY, drawn=surrogate) -> DataFrame:
    """(kind, canon, value) for distinct (kind, canon): values distinct within a kind, and none
    of them an entity itself. ``drawn`` makes a value from kind, canon, attempt and key."""
    real = entities.select("kind", F.col("canon").alias("value"))
    done: list[DataFrame] = []
    pending = entities.select("kind", "canon")
    for attempt in range(ATTEMPTS):
        made = stage(
            pending.withColumn("value", drawn(F.col("kind"), F.col("canon"), F.lit(attempt), key)), "drawn"
        )
        first = made.groupBy("kind", "value").agg(F.min("canon").alias("canon"))
        free = first.join(real, ["kind", "value"], "left_anti")
        for earlier in done:
            free = free.join(earlier, ["kind", "value"], "left_anti")
        free = stage(free.select("kind", "canon", "value"), "free")
        done.append(free)
        pending = stage(made.join(free, ["kind", "canon"], "left_anti").select("kind", "canon"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
    # One row for each type.
    longest = entities.groupBy("kind").agg(F.max(F.length("canon")).alias("longest"))
    value = longer_surrogate(F.col("kind"), F.col("canon"), F.col("longest"), key)
    done.append(stage(pending.join(F.broadcast(longest), "kind").select("kind", "canon", value.alias("value")), "longer"))
    return reduce(DataFrame.unionByName, done)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_private``, their number."""
    # The pattern runs once over each text; what it found is written beside the text.
    matched = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    found = stage(docs.withColumn("_found", matched).withColumn("_at", F.monotonically_increasing_id()), "found")
    none = F.coalesce(F.size("_found") <= 0, F.lit(True))
    clean = found.filter(none).drop("_found", "_at").withColumn("n_private", F.lit(0))
    # Names found by a title are looked for once more without it.
    named = found.filter(~none).withColumn("_names", names_of(F.col("_found"))).withColumn("_pattern", pattern_with(F.col("_names")))
    again = F.when(F.size("_names") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_found"))
    private = stage(named.withColumn("_found", again).drop("_pattern"), "private")
    raw = private.select(F.col("_at").alias("at"), "_names", F.posexplode("_found").alias("place", "raw"))
    typed = raw.withColumn("kind", kind_of(F.col("raw")))
    places = stage(
        typed.select("at", "place", "raw", "kind", F.posexplode(parts_of(F.col("kind"), F.col("raw"), F.col("_names"))).alias("part", "canon")),
        "places",
    )
    table = stage(surrogate_table(places.select("kind", "canon").distinct(), key), "surrogates")
    # Arrays hold what one text holds.
    filled = (
        places.join(table, ["kind", "canon"])
        .groupBy("at", "place")
        .agg(F.first("raw").alias("raw"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("part", "value"))).alias("v"))
        .select("at", "place", written(F.col("kind"), F.col("raw"), F.col("v.value")).alias("new"))
        .groupBy("at")
        .agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("n"))
        .select(F.col("at").alias("_at"), F.col("n.new").alias("_new"))
    )
    between = F.split("text", pattern_with(F.col("_names")), -1)
    pieces = F.zip_with(between, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    replaced = (
        private.join(filled, "_at")
        .withColumn("text", F.array_join(pieces, ""))
        .withColumn("n_private", F.size("_found"))
    )
    return clean.unionByName(replaced.select(*clean.columns))
