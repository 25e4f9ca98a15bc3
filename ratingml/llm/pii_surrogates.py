"""Personal data replaced by keyed surrogates of the same kind, with built-in functions only.

Found: e-mail addresses, telephone numbers, card numbers (13 to 19 digits), social
security numbers, IPv4 addresses, hexadecimal secrets (32 digits or more), and names
after a form of address (Mr., Frau, Sra., г-жа, ...).

A surrogate comes from SHA-256 of the secret key, the kind and the canonical form
(lower case, digits only, the name without its form of address), so the same entity
gets the same surrogate in every document, however it is written. It keeps the kind,
the length and punctuation of numbers and addresses, the country code, the card's
first digit and valid check digit, the top-level domain, upper case, the script of a
name and the gender that the form of address shows. Mail addresses of one domain stay
in one domain, and people of one surname share one.

Collision checks: all distinct entities of the table are listed once. Surrogates
that two entities share, or that are themselves an entity of the table, are drawn
again with the next attempt number, until every entity has one of its own.

Only texts with an entity take part in the join with the list; their key is a hash
of the text, so copies of a text are looked up once. All other texts pass through.

Defined results: null and empty texts have no entity and stay as they are. Repeated
rows and other columns pass through; columns of any name are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingml.llm.common import kept_apart, quoted, stored

MALE = ("Mr", "Herr", "Herrn", "Sr", "Señor", "Monsieur", "г-н", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "г-жа", "госпожа")

_NAME = r"\p{Lu}[\p{L}\p{M}'’-]*"
_TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
_EMAIL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@-])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.[0-9])"
_CARD = r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z]|-[0-9])"
_SSN = r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
_LOCAL = r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: A further group of an international number, never the start of a mail address or card number. Numbers that are
#: entities of their own are set apart where the rest is a number without them, else they belong to it.
_GROUP = rf"(?![ .-]?(?:{_EMAIL}|{_CARD}(?![ -][0-9]{{4}})))[ .-]?[0-9]{{2,4}}"
_APART = rf"(?![ .-]?(?:{_IP}|{_SSN}|{_CARD})| {_LOCAL})"
#: Behind a number of more than 15 digits; written out, since a look-behind takes no repeated group.
_NOT_LONG = r"(?<!\+" + r"[ .()-]{0,3}[0-9]" * 16 + r"[0-9 .()-]{0,30})"
_WORD = rf"(?!{_EMAIL}|(?:{_TITLES})\.? \p{{Lu}}){_NAME}"
#: Kinds in the order in which they are tried at a place.
KINDS = {
    "email": _EMAIL,
    "ip": _IP,
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,256}(?![0-9A-Za-z])",
    "card": _CARD,
    "ssn": _SSN,
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}"
    rf"(?:(?:{_APART}{_GROUP}){{1,4}}|(?:{_GROUP}){{1,4}})(?![0-9A-Za-z]){_NOT_LONG}"
    rf"|(?:\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}})(?![0-9A-Za-z]))",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}}(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every entity holds: texts without it are not searched.
HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"

#: From this attempt on the values that a surrogate is drawn from grow with each one, so that no form is ever full.
WIDER_FROM = 8
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Syllables and endings of invented names, by script.
_SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ko", "la", "le", "ma", "mi", "na", "ro", "sa", "ta", "ve", "wi"),
    "cyrillic": ("ба", "бе", "во", "га", "да", "де", "жа", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "ро", "са", "та", "ве", "фи"),
}
_GIVEN_ENDS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на"}
_LAST_ENDS = {("latin", "m"): "ler", ("latin", "f"): "ler", ("cyrillic", "m"): "ров", ("cyrillic", "f"): "рова"}


def _draw(key: str, *parts: Column, blocks: int = 1) -> Column:
    """``64 * blocks`` hexadecimal digits from the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), seed), 256) for i in range(blocks)])


def _number(hexes: Column, at: Column | int, top: int) -> Column:
    """A number below ``top`` from four digits of a draw, from place ``at`` (0-based, wrapped)."""
    start = F.pmod(F.lit(at) if isinstance(at, int) else at, F.length(hexes) - 3) + 1
    return F.conv(F.substring(hexes, start, F.lit(4)), 16, 10).cast("int") % top


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shaped(text: Column, hexes: Column) -> Column:
    """Letters a-z and digits replaced one by one, the rest kept."""
    return F.array_join(
        F.transform(
            _characters(text),
            lambda c, i: F.when(F.rlike(c, F.lit("[0-9]")), _number(hexes, i * 4, 10).cast("string"))
            .when(F.rlike(c, F.lit("[a-z]")), F.substring(F.lit(_LETTERS), _number(hexes, i * 4, 26) + 1, F.lit(1)))
            .otherwise(c),
        ),
        "",
    )


def _wider(attempt: Column) -> Column:
    """How many characters more a surrogate has: none at first, then one per attempt."""
    return F.greatest(F.lit(0), attempt - (WIDER_FROM - 1))


def _email(canonical: Column, own: Column, shared: Column, wider: Column) -> Column:
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    zone = F.substring_index(domain, ".", -1)
    hosts = F.substring(domain, F.lit(1), F.length(domain) - F.length(zone) - 1)
    local = F.concat(local, F.repeat(F.lit("a"), wider))
    return F.concat(_shaped(local, own), F.lit("@"), _shaped(hosts, shared), F.lit("."), zone)


def _ip(canonical: Column, hexes: Column, wider: Column) -> Column:
    """Parts of as many digits; if wider, all of three, and beyond that (156^4 addresses) more parts."""
    canonical = F.concat(canonical, F.repeat(F.lit(".000"), F.greatest(F.lit(0), wider - 8)))
    part = lambda p, i: (
        F.when((F.length(p) == 3) | (wider > 0), 100 + _number(hexes, i * 8, 156))
        .when(F.length(p) == 2, 10 + _number(hexes, i * 8, 90))
        .otherwise(1 + _number(hexes, i * 8, 9))
    )
    return F.array_join(F.transform(F.split(canonical, r"\."), lambda p, i: part(p, i).cast("string")), ".")


def _luhn(digits: Column, last: bool) -> Column:
    """Sum of the check rule over all digits; ``last`` tells whether the check digit is among them."""
    doubled = 1 if last else 0
    return F.aggregate(
        F.transform(F.reverse(_characters(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2 == doubled).alias("twice"))),
        F.lit(0),
        lambda acc, x: acc + F.when(x["twice"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]),
    )


def _digits(canonical: Column, own: Column, kept: Column) -> Column:
    """Digits replaced but for the first ``kept``."""
    drawn = _shaped(canonical, own)
    return F.concat(F.substring(canonical, F.lit(1), kept), F.substring(drawn, kept + 1, F.length(canonical)))


def _checked(canonical: Column, number: Column) -> Column:
    """The last digit of a card number made valid where the real one is."""
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    right = F.concat(body, F.pmod(-_luhn(body, False), F.lit(10)).cast("string"))
    return F.when(_luhn(canonical, True) % 10 == 0, right).otherwise(number)


def _invented(word: Column, role: Column, script: Column, end: Column, attempt: Column, wider: Column, key: str) -> Column:
    """Four syllables, or more if wider, and an ending; ``role`` keeps given names of both genders and surnames apart."""
    hexes = _draw(key, role, word, attempt)
    sounds = F.when(script == "cyrillic", F.array(*[F.lit(s) for s in _SYLLABLES["cyrillic"]])).otherwise(
        F.array(*[F.lit(s) for s in _SYLLABLES["latin"]])
    )
    picks = F.transform(F.sequence(F.lit(0), wider + 3), lambda i: F.get(sounds, _number(hexes, i * 4, len(_SYLLABLES["latin"]))))
    return F.initcap(F.concat(F.array_join(picks, ""), end))


def _name(canonical: Column, kind: Column, attempt: Column, key: str) -> Column:
    """``canonical`` is the lower-cased name; the surname is drawn from its own word, so it is shared."""
    words = F.split(canonical, " ")
    script = F.when(F.rlike(canonical, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    gender = F.substring(kind, -1, 1)

    def end(ends: dict[tuple[str, str], str]) -> Column:
        found = F.lit("")
        for (own_script, own_gender), text in ends.items():
            found = F.when((script == own_script) & (gender == own_gender), text).otherwise(found)
        return found

    tries, wider = attempt.cast("string"), _wider(attempt)
    given = F.transform(
        F.slice(words, F.lit(1), F.size(words) - 1),
        lambda w: _invented(w, F.concat(F.lit("given"), gender), script, end(_GIVEN_ENDS), tries, wider, key),
    )
    # only a name without a given name has to try another surname
    last_try = F.when(F.size(words) == 1, tries).otherwise(F.lit("0"))
    last_wider = F.when(F.size(words) == 1, wider).otherwise(F.lit(0))
    last = _invented(F.element_at(words, -1), F.lit("last"), script, end(_LAST_ENDS), last_try, last_wider, key)
    return F.array_join(F.concat(given, F.array(last)), " ")


def kind_of(raw: Column) -> Column:
    """The kind of a match; names carry the gender."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        if name == "name":
            male = F.rlike(raw, F.lit("^(?:" + "|".join(sorted(MALE, key=len, reverse=True)) + r")\.? "))
            kind = F.when(F.rlike(raw, F.lit(f"^(?:{pattern})$")), F.when(male, "name-m").otherwise("name-f")).otherwise(kind)
        else:
            kind = F.when(F.rlike(raw, F.lit(f"^(?:{pattern})$")), name).otherwise(kind)
    return kind


def canonical_of(raw: Column, kind: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    # the country code is part of a phone number and of its form
    phone = F.concat(F.when(raw.startswith("+"), F.concat(F.regexp_extract(raw, r"^\+([0-9]{1,3})", 1), F.lit("|"))).otherwise(F.lit("|")), digits)
    name = F.lower(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""))
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind.startswith("name"), name)
        .otherwise(F.lower(raw))
    )


def with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to ``kind, canonical, attempt``: the drawn replacement of the canonical form."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    domain = F.substring_index(canonical, "@", -1)
    rows = kept_apart(
        rows,
        __own=_draw(key, kind, canonical, attempt.cast("string"), blocks=4),
        __domain=_draw(key, F.lit("domain"), domain, blocks=4),
    )
    own, wider = F.col("__own"), _wider(attempt)
    more = F.repeat(F.lit("0"), wider)
    code, number = F.substring_index(canonical, "|", 1), F.substring_index(canonical, "|", -1)
    drawn = (
        F.when(kind == "email", _email(canonical, own, F.col("__domain"), wider))
        .when(kind == "ip", _ip(canonical, own, wider))
        .when(kind == "secret", F.substring(own, F.lit(1), F.length(canonical) + wider))
        .when(kind == "phone", F.concat(code, F.lit("|"), _digits(F.concat(number, more), own, F.length(code))))
        .when(kind.startswith("name"), _name(canonical, kind, attempt, key))
        .otherwise(_digits(F.concat(canonical, more), own, F.when(kind == "card", 1).otherwise(0)))
    )
    rows = kept_apart(rows, __drawn=drawn).drop("__own", "__domain")
    checked = F.when(kind == "card", _checked(canonical, F.col("__drawn"))).otherwise(F.col("__drawn"))
    return rows.withColumn("surrogate", checked).drop("__drawn")


def written_as(raw: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the form in which the entity was written."""
    digits = F.substring_index(surrogate, "|", -1)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    filled = F.aggregate(
        _characters(raw),
        start,
        lambda acc, c: F.when(
            F.rlike(c, F.lit("[0-9]")),
            F.struct(F.concat(acc["text"], F.substring(digits, acc["used"] + 1, F.lit(1))).alias("text"), (acc["used"] + 1).alias("used")),
        ).otherwise(F.struct(F.concat(acc["text"], c).alias("text"), acc["used"].alias("used"))),
        # a wider surrogate has digits left
        lambda acc: F.concat(acc["text"], F.substring(digits, acc["used"] + 1, F.length(digits))),
    )
    cased = F.array_join(
        F.zip_with(_characters(raw), _characters(surrogate), lambda a, b: F.when(F.rlike(a, F.lit("[A-Z]")), F.upper(b)).otherwise(b)), ""
    )
    title = F.regexp_extract(raw, rf"^((?:{_TITLES})\.? )", 1)
    shout = F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", "")
    name = F.concat(title, F.when((shout == F.upper(shout)) & (F.length(shout) > 1), F.upper(surrogate)).otherwise(surrogate))
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind.startswith("name"), name).otherwise(cased)


def entities(text: Column) -> Column:
    """All matches in a text, in order; null for a text without any hint."""
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), 0))


def assigned(found: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for the distinct entities in ``kind, canonical``, without collisions.

    Entities whose draw collides draw again, from ``WIDER_FROM`` attempts on among longer values, so this ends
    for any number of entities of one form.
    """
    rows = stored(found.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    while True:
        drawn = with_surrogate(rows, key)
        drawn = stored(drawn, "pii-drawn")
        group = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical")
        real = rows.select(F.col("kind").alias("__kind"), _comparable(F.col("canonical"), F.col("kind")).alias("__real"), F.lit(True).alias("__taken"))
        checked = drawn.withColumn("__place", F.row_number().over(group))
        checked = checked.join(
            real, (F.col("kind") == F.col("__kind")) & (_comparable(F.col("surrogate"), F.col("kind")) == F.col("__real")), "left"
        )
        again = (F.col("__place") > 1) | F.col("__taken").isNotNull()
        checked = stored(checked.select("kind", "canonical", "attempt", "surrogate", again.alias("again")), "pii-checked")
        if checked.filter("again").isEmpty():
            return checked.select("kind", "canonical", "surrogate")
        rows = checked.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def _comparable(value: Column, kind: Column) -> Column:
    return F.when(kind.startswith("name"), F.lower(value)).otherwise(value)


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced; ``count_col`` adds the number of entities.

    ``n_chars`` follows where it is present.
    """
    columns = docs.columns
    text = quoted(text_col)
    marked = docs.withColumn("__found", entities(text)).withColumn("__n", F.coalesce(F.size("__found"), F.lit(0)))
    # a text with many matches and its copies are one row here
    with_any = docs.filter(F.rlike(text, F.lit(HINT))).select(F.sha2(text, 256).alias("__key"), entities(text).alias("__found"))
    each = with_any.select("__key", F.explode(F.array_distinct("__found")).alias("raw")).distinct()
    each = each.withColumn("kind", kind_of(F.col("raw"))).withColumn("canonical", canonical_of(F.col("raw"), F.col("kind")))
    each = stored(each, "pii-found")
    chosen = assigned(each, key)
    joined = each.join(chosen, ["kind", "canonical"])
    pairs = joined.select("__key", F.struct("raw", written_as(F.col("raw"), F.col("kind"), F.col("surrogate")).alias("new")).alias("pair"))
    lists = stored(pairs.groupBy("__key").agg(F.map_from_entries(F.collect_list("pair")).alias("__map")), "pii-lists")
    found = marked.filter("__n > 0").withColumn("__key", F.sha2(text, 256)).join(lists, "__key", "left")
    between = F.split(text, PATTERN, -1)
    news = F.transform("__found", lambda raw: F.element_at("__map", raw))
    pieces = F.zip_with(between, F.concat(news, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    found = found.withColumn("__new", F.array_join(pieces, ""))
    plain = marked.filter("__n = 0").withColumn("__new", text)
    keep = [F.col("__new").alias(c) if c == text_col else quoted(c) for c in columns]
    if "n_chars" in columns:
        keep[columns.index("n_chars")] = F.length("__new").cast("long").alias("n_chars")
    if count_col:
        keep.append(F.col("__n").cast("long").alias(count_col))
    return plain.select(*keep).unionByName(found.select(*keep))
