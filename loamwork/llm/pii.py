"""PII: surrogate generation for detected entities.

Entities are e-mail (in any script) and IP addresses, social security, phone, card and account
(IBAN) numbers, and names.  Each is replaced by a surrogate of its own type and format, made from a keyed digest
of its canonical form: letters stay letters and digits digits where they stood, a card number
that passes the Luhn test still does, an IP address is valid, a name keeps its title and gets a
given name of the title's gender in its own script.

Names are found after a title; the persons of a document that are named so are then looked for
in all of it: given and family name, either alone, without a title.  (A capitalised ordinary
word that is also such a person's name is taken for it.)  A family name, with a title or without, is
the first person of the document who has it and whose gender fits.  A person under a title without gender, "Dr.
John Smith", is the "Mr. John Smith" of the corpus if there is one and no "Mrs. John Smith".

One canonical form has one surrogate, however it is written, so mentions still corefer.
Distinctness is checked over the whole corpus: canonical forms that would share a surrogate, or
whose surrogate is itself an entity of the corpus, are all but the first drawn again with the
next attempt number until none is left; otherwise an error is raised.  Where a format is
full, addresses, names and telephone numbers grow longer; for numbers of a length that a quarter of all
forms fill, from the start.  Those few exceptions reach the texts as a map, sent along if their counted
number is small, else joined by document.

Built-in functions only.  A null text stays null, with no entities.  Repeated and null doc_ids
are kept apart (see `common.doc_rows` where exceptions are joined).  Other columns of the input
are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged
from .spans import bind, located, total

KEY, ROUNDS, LAST, COUNTRY = "surrogate-key", 24, 40, "1"

#: Titles by gender, and given names by gender and script.
TITLES = {
    "m": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Господин", "Κύριος"),
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа", "Κυρία"),
    "n": ("Dr.", "Prof."),
}
GIVEN = {
    "m latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar"),
    "f latin": ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria"),
    "n latin": ("Alex", "Chris", "Kim", "Robin", "Sam", "Sascha", "Andrea", "Dominique"),
    "m cyrillic": ("Иван", "Пётр", "Павел", "Олег", "Борис", "Максим"),
    "f cyrillic": ("Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера"),
    "n cyrillic": ("Саша", "Женя", "Валя"),
    "m greek": ("Νίκος", "Πέτρος", "Γιάννης", "Πάνος"),
    "f greek": ("Μαρία", "Ελένη", "Άννα", "Σοφία"),
    "n greek": ("Χάρις", "Θέκλα"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "la", "ne"),
    "cyrillic": ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ла", "не"),
    "greek": ("βα", "δε", "φι", "γο", "χου", "κα", "λε", "μι", "νο", "που", "ρα", "σε", "τι", "βο", "λα", "νε"),
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_titles = "|".join(t.replace(".", r"\.") for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,4}\)?){1,2}(?:[ .-][0-9]{2,8}){1,4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_titles})\x20\p{{Lu}}\p{{L}}+(?:\x20\p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def rule(t, of):
    """A when-chain over the entity types."""
    out = None
    for name in PATTERNS:
        out = F.when(t == name, of(name)) if out is None else out.when(t == name, of(name))
    return out


def kind_of(m):
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(F.rlike(m, F.lit(r"^[A-Z]{2}[0-9]{2}")), "iban")
        .when(F.rlike(m, F.lit(r"^\p{L}")), "name")
        .when(F.rlike(m, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")) & F.rlike(m, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")), "ip")
        .when(F.rlike(m, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn")
        .when(F.startswith(m, F.lit("+")) | F.rlike(m, F.lit(PATTERNS["phone"])) & (F.length(digits) <= 13), "phone")
        .otherwise("card")
    )


def title_of(m):
    return F.regexp_extract(m, rf"^({_titles})\x20", 1)


def canonical(t, m):
    """What all ways to write one entity have in common."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    gender = F.when(title_of(m).isin(*TITLES["m"]), "m").when(title_of(m).isin(*TITLES["f"]), "f").otherwise("n")
    # a name's gender is part of it: Mr. Berg and Mrs. Berg are two persons
    name = F.concat_ws(" ", gender, F.lower(F.regexp_replace(m, rf"^(?:{_titles})\x20", "")))
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(m, r"^\+([0-9]{1,3}?)(?:[^0-9]|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)", 1)).otherwise(F.lit(COUNTRY))
    rest = F.when(F.startswith(m, F.lit("+")), F.substr(digits, F.length(code) + 1, F.length(digits))).otherwise(digits)
    return rule(t, lambda k: {"email": F.lower(m), "ip": m, "ssn": digits, "phone": F.concat_ws("-", code, rest), "card": digits, "name": name, "iban": F.replace(m, F.lit(" "))}[k])


def draw(t, norm, attempt, key: str):
    """array of 2 x 64 hexadecimal digits and their decimal reading, from a keyed digest."""
    seed = F.concat_ws("|", F.lit(key), t, attempt.cast("string"), norm)
    return bind(F.sha2(seed, 256), lambda h: F.concat(h, F.sha2(F.concat(h, F.lit(key)), 256)))


def digit(h, i):
    """Decimal digit i (from 1) of a draw: two hexadecimal digits modulo 10."""
    return (F.conv(F.substr(h, (i * 2 - 1) % 126 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")


def nibble(h, i):
    return F.conv(F.substr(h, (i - 1) % 127 + 1, F.lit(1)), 16, 10).cast("int")


def luhn(digits):
    """Sum of the Luhn test: every second digit from the right doubled."""
    d = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.coalesce(total(F.transform(d, lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0))


def number(norm, h):
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: digit(h, i)), "")


def phone(norm, h, attempt):
    """Country code, hyphen, number: the code stays; six digits more once the format is full."""
    parts = F.split(norm, "-")
    more = F.array_join(F.transform(F.sequence(F.lit(41), F.lit(46)), lambda i: digit(h, i)), "")
    return F.concat_ws("-", F.get(parts, 0), F.concat(number(F.get(parts, 1), h), F.when(attempt >= ROUNDS, more).otherwise(F.lit(""))))


def card(norm, h):
    body = bind(F.length(norm), lambda n: F.concat(F.left(norm, F.lit(1)), F.substr(number(norm, h), F.lit(2), n - 2)))
    check = lambda b: ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")
    return bind(body, lambda b: F.concat(b, F.when(luhn(norm) % 10 == 0, check(b)).otherwise(digit(h, F.length(norm)))))


def address(norm, h):
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.conv(F.substr(h, i * 4, F.lit(3)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")


#: Letters to draw from, by script.
ALPHABETS = {"cyrillic": "бвгдклмнпрстаеио", "greek": "βγδζκλμνπρσταειο", "latin": "bdfgklmnprstaeio"}


def letters(text, h, attempt):
    """Letters and digits of an address drawn anew where they stand; the last label stays."""
    of = {k: F.array(*[F.lit(c) for c in v]) for k, v in ALPHABETS.items()}

    def one(c, i):
        script = F.when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), of["cyrillic"]).when(F.rlike(c, F.lit(r"\p{IsGreek}")), of["greek"]).otherwise(of["latin"])
        return F.when(F.rlike(c, F.lit("[0-9]")), digit(h, i)).when(F.rlike(c, F.lit(r"\p{L}")), F.get(script, nibble(h, i))).otherwise(c)

    label = F.regexp_extract(text, r"(\.\p{L}+)$", 1)
    head = F.left(text, F.length(text) - F.length(label))
    drawn = bind(head, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: bind(F.substr(x, i, F.lit(1)), lambda c: one(c, i))), ""))
    # short addresses have few forms: once these are full, addresses grow longer
    return F.concat(F.when(attempt >= ROUNDS, F.left(h, F.lit(12))).otherwise(F.lit("")), drawn, label)


def account(norm, h):
    """An account number of the same country, letters and digits where they stood, its check digits right."""
    capital = F.array(*[F.lit(c) for c in "ABCDEFGHJKLMNPRS"])
    one = lambda c, i: F.when(F.rlike(c, F.lit("[0-9]")), digit(h, i)).otherwise(F.get(capital, nibble(h, i)))
    land = F.left(norm, F.lit(2))
    body = F.array_join(F.transform(F.sequence(F.lit(5), F.length(norm)), lambda i: bind(F.substr(norm, i, F.lit(1)), lambda c: one(c, i))), "")
    # ISO 7064: letters count from 10, the whole modulo 97 is 1
    value = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)))
    rest = lambda x: F.aggregate(chars(x), F.lit(0), lambda a, c: bind(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return bind(body, lambda b: F.concat(land, F.lpad((98 - rest(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))


def person(norm, h, attempt):
    """gender, given and family name in the name's script; the shape follows the original."""
    script = F.when(F.rlike(norm, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(norm, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
    given = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    syllables = F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    count = F.when(attempt >= ROUNDS, 8).otherwise(4)
    family = bind(F.element_at(syllables, script), lambda s: F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(s, nibble(h, i + 8))), ""))
    first = bind(F.element_at(given, F.concat_ws(" ", F.left(norm, F.lit(1)), script)), lambda g: F.lower(F.get(g, F.conv(F.left(h, F.lit(7)), 16, 10).cast("int") % F.size(g))))
    two = F.size(F.split(norm, " ")) > 2
    return F.concat_ws(" ", F.left(norm, F.lit(1)), F.when(two, first), family)


def surrogate(t, norm, attempt, key: str = KEY):
    """Canonical form of the surrogate of a canonical form."""
    return bind(draw(t, norm, attempt, key), lambda h: rule(t, lambda k: {"email": letters(norm, h, attempt), "ip": address(norm, h), "ssn": number(norm, h), "phone": phone(norm, h, attempt), "card": card(norm, h), "iban": account(norm, h), "name": person(norm, h, attempt)}[k]))


def written(t, m, norm, new, part):
    """The surrogate in the format of the mention m of an entity, or of a part of its name."""

    def filled(m, new, kept):
        # what m itself holds of them: a country code may be left out
        parts = F.split(m, kept, -1)
        n = F.size(parts) - 1
        return bind(F.right(F.replace(new, F.lit("-")), n), lambda d: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substr(d, i + 1, F.lit(1)))), ""))

    def longer(m, new):
        # digits beyond the format follow the last
        more = F.length(new) - F.length(norm)
        return F.concat(filled(m, F.left(new, F.length(norm)), "[0-9]"), F.right(new, more))

    shout = lambda s: F.when(m == F.upper(m), F.upper(s)).otherwise(s)
    name = rule_of_part(part, F.substr(new, F.lit(3), F.length(new)))
    title = title_of(m)
    called = F.when(title == "", m).otherwise(F.substr(m, F.length(title) + 2, F.length(m)))
    cased = F.when(called == F.upper(called), F.upper(name)).otherwise(F.initcap(name))
    entitled = F.when(title == "", cased).otherwise(F.concat_ws(" ", title, cased))
    return rule(t, lambda k: {"email": shout(new), "ip": new, "name": entitled, "phone": longer(m, new)}.get(k, filled(m, new, "[0-9A-Z]" if k == "iban" else "[0-9]")))


def rule_of_part(part, name):
    """All of "given family", or one of the two."""
    words = F.split(name, " ")
    return F.when(part == "family", F.element_at(words, -1)).when(part == "given", F.get(words, 0)).otherwise(name)


def entities(text):
    """array<struct<start,end,m,type,norm,part>> of a text's entities."""
    typed = lambda e: bind(kind_of(e["m"]), lambda t: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["m"].alias("m"), t.alias("type"), canonical(t, e["m"]).alias("norm"), F.lit("all").alias("part")))
    return bind(F.transform(located(text, ANY), typed), lambda found: F.when(F.exists(found, lambda e: e["type"] == "name"), with_mentions(text, found)).otherwise(found))


def with_mentions(text, found):
    """The entities, family names linked to the document's persons, and the persons' further mentions."""
    names = F.filter(found, lambda e: e["type"] == "name")
    words = lambda norm: F.split(norm, " ")  # noqa: E731  gender, [given,] family
    family, gender = (lambda norm: F.element_at(words(norm), -1)), (lambda norm: F.left(norm, F.lit(1)))

    def linked(e, persons):
        fits = lambda p: (F.size(words(p)) == 3) & (family(p) == family(e["norm"])) & ((gender(p) == gender(e["norm"])) | (gender(p) == "n") | (gender(e["norm"]) == "n"))
        whole = F.get(F.filter(persons, fits), 0)
        alone = (e["type"] == "name") & (F.size(words(e["norm"])) == 2) & whole.isNotNull()
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), e["m"].alias("m"), e["type"].alias("type"), F.when(alone, whole).otherwise(e["norm"]).alias("norm"), F.when(alone, "family").otherwise("all").alias("part"))

    def resolved(b, persons):
        low = F.lower(b["m"])
        first = lambda cond: F.get(F.filter(persons, cond), 0)
        whole, last, given = first(lambda p: F.substr(p, F.lit(3), F.length(p)) == low), first(lambda p: family(p) == low), first(lambda p: (F.size(words(p)) == 3) & (F.get(words(p), 1) == low))
        part = F.when(whole.isNotNull(), "all").when(last.isNotNull(), "family").otherwise("given")
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), b["m"].alias("m"), F.lit("name").alias("type"), F.coalesce(whole, last, given).alias("norm"), part.alias("part"))

    def joined(persons, known):
        called = F.transform(names, lambda e: F.regexp_replace(e["m"], rf"^(?:{_titles})\x20", ""))
        forms = F.array_distinct(F.flatten(F.transform(called, lambda c: F.concat(F.array(c), F.split(c, " ")))))
        longest = F.array_sort(F.transform(forms, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        free = lambda b: ~F.exists(known, lambda e: (e["start"] < b["end"]) & (b["start"] < e["end"]))
        more = bind(pattern, lambda p: F.transform(F.filter(located(text, p), free), lambda b: resolved(b, persons)))
        return F.array_sort(F.concat(known, more))

    persons = F.array_distinct(F.transform(names, lambda e: e["norm"]))
    return bind(persons, lambda persons: bind(F.transform(found, lambda e: linked(e, persons)), lambda known: joined(F.array_distinct(F.transform(F.filter(known, lambda e: e["type"] == "name"), lambda e: e["norm"])), known)))


def one_person(norms: DataFrame) -> DataFrame:
    """(norm, person): names under a title without gender that one gender has in the corpus."""
    names = norms.filter("type = 'name'").select(F.left("norm", F.lit(1)).alias("g"), F.expr("substr(norm, 3)").alias("name"))
    has = lambda g: F.max((F.col("g") == g).cast("int")) == 1
    both = names.groupBy("name").agg(has("m").alias("m"), has("f").alias("f"), has("n").alias("n")).filter("n AND m <> f")
    return both.select(F.concat(F.lit("n "), "name").alias("norm"), F.concat(F.when(F.col("m"), "m ").otherwise("f "), "name").alias("person"))


def exceptions(norms: DataFrame, key: str = KEY, rounds: int = LAST) -> DataFrame:
    """(type, norm, attempt) of the canonical forms whose first surrogate can't stand.

    `norms` holds distinct staged (type, norm).  Each round draws for those that lost the
    last one and meets all surrogates; an original counts as taken, so does a settled
    surrogate.  Grouping and joins are by surrogate, which are nearly distinct.
    """
    parts = F.split("norm", "-")
    numbers = norms.filter("type = 'phone'").select(F.get(parts, 0).alias("code"), F.length(F.get(parts, 1)).alias("digits"))
    full = numbers.groupBy("code", "digits").count().filter(F.col("count") * 4 > F.pow(F.lit(10.0), "digits")).select("code", "digits")  # codes of 3 digits, and lengths
    crowded = (F.col("type") == "phone") & (F.get(parts, 0) == F.col("code")) & (F.length(F.get(parts, 1)) == F.col("digits"))
    attempt = F.when(F.col("code").isNotNull(), ROUNDS).otherwise(0)
    drawn = norms.join(F.broadcast(full), crowded, "left").select("type", "norm", attempt.alias("attempt"))
    settled = staged(drawn.withColumn("new", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), key)), "surrogates")
    taken = norms.select(F.col("type").alias("t2"), F.col("norm").alias("n2"))
    for _ in range(rounds):
        first = F.row_number().over(Window.partitionBy("type", "new").orderBy("attempt", "norm"))
        marked = settled.withColumn("rn", first).join(taken.hint("merge"), (F.col("type") == F.col("t2")) & (F.col("new") == F.col("n2")), "left")
        marked = staged(marked.select("type", "norm", "attempt", "new", ((F.col("rn") > 1) | F.col("n2").isNotNull()).alias("lost")), "surrogates")
        lost = marked.filter("lost")
        if not lost.limit(1).take(1):
            return marked.filter("attempt > 0").select("type", "norm", "attempt")
        again = lost.select("type", "norm", (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("new", surrogate(F.col("type"), F.col("norm"), F.col("attempt"), key))
        settled = staged(marked.filter("NOT lost").select("type", "norm", "attempt", "new").unionByName(again), "surrogates")
    raise RuntimeError(f"some entities have no surrogate of their own after {rounds} draws: " + ", ".join(r.type for r in lost.select("type").distinct().collect()))


def rebuilt(text, found, odd, key: str):
    """The text with its entities replaced; odd maps type|norm to a struct of norm and attempt, or is null."""

    def drawn(e):
        known = F.element_at(odd, F.concat_ws("|", e["type"], e["norm"]))
        other = F.struct(e["norm"].alias("norm"), F.lit(0).alias("attempt"))
        return bind(F.coalesce(known, other), lambda k: written(e["type"], e["m"], k["norm"], surrogate(e["type"], k["norm"], k["attempt"], key), e["part"]))

    def joined(found):
        between = F.transform(found, lambda e, i: F.substr(text, F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0) + 1, e["start"] - F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)))
        tail = F.substr(text, F.element_at(found, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(between, F.transform(found, drawn), lambda b, s: F.concat(b, s)), ""), tail)

    return F.when(F.size(found) > 0, joined(found)).otherwise(text)


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, entities): text with surrogates; entities as type:start:end
    of the original text, comma-joined."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # texts are searched once; what is found is written beside them
    rows = staged(rows.withColumns({"rid": F.monotonically_increasing_id(), "found": entities(F.col("text"))}), "found")
    norms = staged(rows.select(F.explode("found").alias("e")).select("e.type", "e.norm").distinct(), "entities")
    persons = staged(one_person(norms), "persons")
    own = staged(norms.join(persons.select(F.lit("name").alias("t2"), F.col("norm").alias("n2")).hint("merge"), (F.col("type") == F.col("t2")) & (F.col("norm") == F.col("n2")), "left_anti"), "entities")
    again = staged(exceptions(own, key), "exceptions")
    attempts = again.filter("type = 'name'").select(F.col("norm").alias("n2"), "attempt").hint("merge")
    same = persons.join(attempts, F.col("person") == F.col("n2"), "left").select(F.lit("name").alias("type"), "norm", F.struct(F.col("person").alias("norm"), F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("odd"))
    odd = staged(again.select("type", "norm", F.struct("norm", "attempt").alias("odd")).unionByName(same), "odd")
    entry = F.struct(F.concat_ws("|", "type", "norm"), "odd")
    if odd.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        d = rows.crossJoin(F.broadcast(odd.agg(F.map_from_entries(F.collect_list(entry)).alias("odd"))))  # one row of few entries
    else:
        mentions = rows.select("rid", F.explode("found").alias("e")).select("rid", "e.type", "e.norm").distinct()
        per_doc = mentions.join(odd.hint("merge"), ["type", "norm"]).groupBy(F.col("rid").alias("rid2")).agg(F.map_from_entries(F.collect_list(entry)).alias("odd"))
        d = rows.join(per_doc.hint("merge"), F.col("rid") == F.col("rid2"), "left")
    listed = F.array_join(F.transform("found", lambda e: F.concat_ws(":", e["type"], e["start"], e["end"])), ",")
    return d.select("doc_id", rebuilt(F.col("text"), F.col("found"), F.col("odd"), key).alias("text"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(listed, F.lit("")).alias("entities"))
