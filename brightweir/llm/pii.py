"""Surrogates for personal data: keyed, of the same kind and format, distinct and consistent.

One regular expression finds all entities of a text. Each has a kind and a canonical
value (digits of a phone number, lower-case address, single parts of a name), so that
all spellings and mentions of one entity meet in one row of the entity table. A keyed
digest of kind, value and attempt gives that row's surrogate: every letter becomes a
letter of its alphabet, every digit a digit, an address of the network stays one, a
number that passes the Luhn check passes it again, and a given name becomes one of the
same gender. A surrogate that equals a real value, or one already given out, is drawn
again for all but one of its claimants until none is left. Texts are then put together
again from what stands between the entities and the surrogates, which take on case and
separators of what they replace.

All steps are DataFrame expressions. Only documents with entities are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved, text_or_empty

# Titles before names by gender, and given names that replace given names.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Srta", "Señora", "Doña", "г-жа", "госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н", "господин"),
    "u": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "f"): "Alma Berta Carla Dora Edith Flora Greta Hanna Irma Julia Klara Laura Maria Nora Olga Paula Rosa Sara Thea Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noel Oscar Paul Ralf Simon Theo Victor".split(),
    ("latin", "u"): "Alex Andrea Chris Dana Eden Jamie Kim Lee Logan Morgan Noa Quinn Robin Sam Sasha Taylor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Кирилл Максим Олег Павел".split(),
    ("cyrillic", "u"): "Саша Женя Валя Слава".split(),
}
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "абвгдежзийклмнопрстуфхцчшщыэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
)
ALL_TITLES = "|".join(form for titles in TITLES.values() for t in titles for form in dict.fromkeys((t, t.upper())))
NAME = r"\p{Lu}\p{L}{1,40}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9.\-]{1,190}\.[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\d\-])",
    "secret": r"\b(?=[0-9a-fA-F]{0,63}\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "name": rf"(?<=\b(?:{ALL_TITLES})\.? ){NAME}(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: without it the expression above is not tried.
HINT = rf"@|\d[ .\-()]{{0,2}}\d|\b(?:{ALL_TITLES})\.? \p{{Lu}}|[0-9a-fA-F]{{32}}"
RELAX = 6  # attempts after which a surrogate may be longer or of other widths, as its format is used up


def kind_of(value: Column, before: Column) -> Column:
    """Kind of a match: the first whose expression takes all of it; ``before`` is the text up to it."""
    first, *rest = [k for k in PATTERNS if k != "name"]
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    out = F.when(whole(first), first)
    for kind in rest:
        out = out.when(whole(kind), kind)
    return out.otherwise("name")


def gender_of(before: Column) -> Column:
    title = F.lower(F.regexp_extract(before, rf"({ALL_TITLES})\.? $", 1))
    return F.when(title.isin(*map(str.lower, TITLES["f"])), "f").when(title.isin(*map(str.lower, TITLES["m"])), "m").otherwise("u")


def parts_of(value: Column, before: Column) -> Column:
    """Array of ``(kind, canon, original)`` of a match: one, or the given name and the surname of a name."""
    kind = kind_of(value, before)
    part = lambda k, c, o: F.struct(k.alias("kind"), c.alias("canon"), o.alias("original"))
    digits, bare = F.regexp_replace(value, r"\D", ""), F.lower(F.regexp_replace(value, r"[ \-]", ""))
    canon = F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", bare).otherwise(F.lower(value))
    given, surname = F.substring_index(value, " ", 1), F.substring_index(value, " ", -1)
    names = F.when(
        value.contains(" "),
        F.array(part(F.concat(F.lit("given_"), gender_of(before)), F.lower(given), given), part(F.lit("surname"), F.lower(surname), surname)),
    ).otherwise(F.array(part(F.lit("surname"), F.lower(value), value)))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, canon, value)))


def draws(key: str, attempt: int, size: Column) -> Column:
    """Array of ``size`` numbers from 0 to 65535: a keyed digest (inner and outer hash) of kind, value, attempt."""
    inner = lambda block: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(attempt)), block.cast("string"), F.col("kind"), F.col("canon")), 256)
    outer = lambda block: F.sha2(F.concat_ws("\x1f", F.lit(key), inner(block)), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / 16).cast("int")), outer)
    digits = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def chosen(text: str | Column, number: Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.substring(text, F.pmod(number, F.length(text)) + 1, F.lit(1))


def letter_for_letter(numbers: Column) -> Column:
    """The canonical value with each digit and letter replaced by another of its alphabet."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(numbers, i)
        out = F.when(c.rlike(r"^\d$"), chosen("0123456789", n))
        out = out.when((F.col("kind") == "secret"), chosen("abcdef", n))
        for alphabet in ALPHABETS[1:]:
            out = out.when(F.lit(alphabet).contains(c), chosen(alphabet, n))
        return out.when(c.rlike(r"^\p{L}$"), chosen(ALPHABETS[0], n)).otherwise(c)

    return F.array_join(F.transform(F.split("canon", ""), one), "")


def address(numbers: Column, relaxed: bool) -> Column:
    """Four octets of the same widths as the original's, of any width if that is used up."""

    def octet(x: Column, i: Column) -> Column:
        n, width = F.get(numbers, i), F.length(x)
        free = F.pmod(n, F.lit(254)) + 1
        fixed = F.when(width == 1, F.pmod(n, F.lit(9)) + 1).when(width == 2, F.pmod(n, F.lit(90)) + 10)
        return (free if relaxed else fixed.otherwise(F.pmod(n, F.lit(156)) + 100)).cast("string")

    return F.array_join(F.transform(F.split("canon", r"\."), octet), ".")


def mail(numbers: Column) -> Column:
    """Local part and domain letter for letter, the top-level domain as it was."""
    top = F.concat(F.lit("."), F.substring_index("canon", ".", -1))
    return F.concat(F.expr("substring(letters, 1, length(letters) - length(substring_index(canon, '.', -1)) - 1)"), top)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum; the last digit counts once, the one before twice, and so on."""
    return F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, b: a + b,
    )


def card(letters: str) -> Column:
    """The drawn digits; the last is set so that Luhn's check turns out as for the original."""
    head = F.expr(f"substring({letters}, 1, length({letters}) - 1)")
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(F.col("canon")), F.lit(10)) == 0, F.concat(head, check.cast("string"))).otherwise(F.col(letters))


def named(numbers: Column, attempt: int) -> Column:
    """A given name of gender and script; used up lists go on with a second name after a hyphen."""
    script = F.when(F.col("canon").rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    out = F.lit(None).cast("string")
    for (alphabet, gender), names in GIVEN.items():
        pool = F.array(*[F.lit(n.lower()) for n in names])
        pick = lambda i: F.get(pool, F.pmod(F.get(numbers, F.lit(i)), F.lit(len(names))))  # noqa: B023, E731
        name = F.concat_ws("-", *[pick(i) for i in range(1 + attempt // RELAX)])
        out = F.when((script == alphabet) & (F.col("kind") == f"given_{gender}"), name).otherwise(out)
    return out


def surrogate(key: str, attempt: int) -> Column:
    """The surrogate that ``(kind, canon)`` draws in an attempt, in canonical form."""
    numbers = draws(key, attempt, F.length("canon") + 8)
    letters = letter_for_letter(numbers)
    extra = [chosen(ALPHABETS[0], F.get(numbers, F.length("canon") + i)) for i in range(min(8, attempt // RELAX))]
    surname = F.concat(letters, *extra) if extra else letters
    return F.struct(numbers.alias("numbers"), letters.alias("letters"), surname.alias("surname"))


def drawn(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    rows = entities.withColumn("draw", surrogate(key, attempt)).select("kind", "canon", "draw.*")
    value = (
        F.when(F.col("kind") == "ip", address(F.col("numbers"), attempt >= RELAX))
        .when(F.col("kind") == "email", mail(F.col("numbers")))
        .when(F.col("kind") == "card", card("letters"))
        .when(F.col("kind") == "phone", F.when(F.length("canon") > 10, F.expr("concat(substring(canon, 1, length(canon) - 10), right(letters, 10))")).otherwise(F.col("letters")))
        .when(F.col("kind") == "surname", F.col("surname"))
        .when(F.col("kind").startswith("given_"), named(F.col("numbers"), attempt))
        .otherwise(F.col("letters"))
    )
    return rows.select("kind", "canon", value.alias("value"))


def surrogates_of(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, value)`` of distinct ``(kind, canon)``: no value is given out twice or is a real one.

    Each round draws for those still without one; of several that draw the same value
    the smallest keeps it. A round needs joins on ``(kind, value)`` only.
    """
    real = entities.select("kind", F.col("canon").alias("value"))
    waiting, given = entities.select("kind", "canon"), None
    attempt = 0
    while True:
        fresh = drawn(waiting, key, attempt).join(real, ["kind", "value"], "left_anti")
        if given is not None:
            fresh = fresh.join(given.select("kind", "value"), ["kind", "value"], "left_anti")
        kept = fresh.groupBy("kind", "value").agg(F.min("canon").alias("canon")).select("kind", "canon", "value")
        given = saved(kept if given is None else given.unionByName(kept), "pii-given")
        waiting = saved(entities.join(given, ["kind", "canon"], "left_anti").select("kind", "canon"), "pii-waiting")
        if waiting.isEmpty():
            return given
        attempt += 1


def dressed(value: Column, original: Column) -> Column:
    """A surrogate in the case and with the separators of what it replaces."""
    kind = F.col("kind")
    place = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    laid = F.array_join(
        F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.substring(value, place(i), F.lit(1))).otherwise(c)), ""
    )
    numeric = F.when(kind.isin("phone", "card", "ssn", "iban"), laid).otherwise(value)
    upper = (original == F.upper(original)) & (original != F.lower(original))
    return F.when(upper, F.upper(numeric)).when(kind.startswith("given_") | (kind == "surname"), F.initcap(numeric)).otherwise(numeric)


def with_entities(docs: DataFrame) -> DataFrame:
    """Documents that hold entities: ``(row, doc, gaps, found)``; ``row`` names a document by id and text."""
    text = text_or_empty()
    return (
        docs.where(text.rlike(HINT))
        .select(
            F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), text)).alias("row"),
            F.struct(*docs.columns).alias("doc"),
            F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"),
        )
        .where(F.size("found") > 0)
        .withColumn("gaps", F.split("doc.text", ANY, -1))
    )


def occurrences(holders: DataFrame) -> DataFrame:
    """``(row, at, part, kind, canon, original)``: the parts of all entities."""
    return (
        holders.select("row", "gaps", F.posexplode("found").alias("at", "match"))
        .select("row", "at", F.posexplode(parts_of(F.col("match"), F.expr("gaps[at]"))).alias("part", "entity"))
        .select("row", "at", "part", "entity.*")
        .distinct()
    )


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of entities in ``pii_entities``.

    All columns are kept; one called ``pii_entities`` is overwritten. Null texts stay
    null and empty ones empty, with no entities. Equal values get equal surrogates in
    all documents, whatever their order; repeated rows give equal results.
    """
    columns = [c for c in docs.columns if c != "pii_entities"]
    docs = docs.select(columns)
    holders = saved(with_entities(docs), "pii-documents")
    parts = saved(occurrences(holders), "pii-occurrences")
    mapping = surrogates_of(saved(parts.select("kind", "canon").distinct(), "pii-entities"), key)
    new = parts.join(mapping, ["kind", "canon"]).select("row", "at", "part", dressed(F.col("value"), F.col("original")).alias("new"))
    mentions = new.groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct("part", "new"))).alias("parts"))
    lines = mentions.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.array_join("parts.new", " ").alias("new")))).alias("news"))
    text = F.array_join(F.zip_with("gaps", F.col("news.new"), lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")
    changed = holders.join(lines, "row").withColumn("put", text).select(
        *[F.col("put").alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in columns], F.size("news").cast("bigint").alias("pii_entities")
    )
    body = text_or_empty()
    others = docs.where(~(body.rlike(HINT) & body.rlike(ANY))).select(*columns, F.lit(0).cast("bigint").alias("pii_entities"))
    return others.unionByName(changed)
