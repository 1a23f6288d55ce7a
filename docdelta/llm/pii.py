"""Surrogates for personal data, in SQL functions only.

Entities are found by pattern. Each distinct entity of the corpus gets one
keyed surrogate of its own type: same length and character classes, names of
the same gender and script, card numbers that keep passing (or failing) the
check digit. Candidates are checked for collisions with each other, with
surrogates already given and with entities of the corpus; losers draw again
with the next attempt number, from a certain one on with ever more characters.
So equal entities stay equal everywhere, and different ones stay different.

A name is found by a title. Its words (given names, and a surname last) are
entities of their own, and wherever one of them stands in the same document
without a title, it is replaced too. Titles vote on the gender of a given name
over the whole corpus: one gender if no title speaks for the other, else a
name for either. So a person keeps one name whatever titles come before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, new_folder
from .sketches import let

#: For the test tables, and no secret. Set ``spark.docdelta.pii.key`` for any other data.
TEST_KEY = "the test tables hold no real person"
#: From this attempt on surrogates grow by a character an attempt, so that no space of values runs out.
GROWS = 10

# Titles by gender, name parts by script and gender.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "господин", "Κύριος", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Госпожа", "госпожа", "Κυρία", "κυρία"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "Latin": {"m": "Adam Bruno Carl David Emil Frank Georg Hugo Ivan Jonas Karl Leo Martin Nils Oskar Paul", "f": "Anna Berta Clara Diana Emma Frida Greta Helena Irma Julia Karla Lena Maria Nora Olga Paula", "n": "Alex Charlie Kim Robin Sam Jamie Kerry Toni"},
    "Cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл", "f": "Анна Вера Галина Дарья Елена Зоя Ирина Ксения", "n": "Саша Женя Валя Шура"},
    "Greek": {"m": "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος", "f": "Άννα Ελένη Ζωή Κατερίνα Μαρία Σοφία", "n": "Άρης Φώτης"},
}
SYLLABLES = {
    "Latin": "ba den fi gor hal jen ko lun mar nes or pel ris sto tem val",
    "Cyrillic": "ба ден фи гор ха лен ко лун мар нес ор пел рис сто тем вал",
    "Greek": "βα δεν φι γορ χα λεν κο λου μαρ νες ορ πελ ρις στο τεμ βαλ",
}
ENDINGS = {"Latin": {"m": "n", "f": "a", "n": "y", "s": "er"}, "Cyrillic": {"m": "ей", "f": "я", "n": "о", "s": "ко"}, "Greek": {"m": "ος", "f": "α", "n": "ι", "s": "ου"}}

# The entity patterns, in order of precedence.
EDGE = r"(?<![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{LABEL}(?:\.{LABEL})*\.\p{{L}}{{2,}}"
IBAN = EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
HEX = EDGE + r"[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])"
KEY = EDGE + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9-]{20,})(?![\p{L}\p{N}])"
ASSIGNED = r"(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key) {0,2}[=:] {0,2}[\"'])(?=[^\s\"']*[\p{L}\p{N}])[^\s\"']{6,}+(?=[\"'])"
IPV4 = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
IPV6 = r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
PHONE = r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
TITLE = rf"(?:{'|'.join(t for group in TITLES.values() for t in group)})\.?"
WORD = rf"(?!{TITLE}(?!\p{{L}}))(?=\p{{Lu}}[\p{{L}}'’-])\p{{Lu}}\p{{L}}*+(?:['’-](?!s(?!\p{{L}}))\p{{L}}++)*+"
NAME = rf"{EDGE}(?:{TITLE} )+{WORD}(?: {WORD}){{0,2}}"
CODES = "|".join([EMAIL, HEX, KEY, ASSIGNED, IPV4, IPV6, SSN, IBAN, PHONE, CARD])
PATTERN = f"{CODES}|{NAME}"
#: In texts with a name, also each other capitalised word; with the space after it if another one follows.
ANY_WORD = f"({PATTERN})|{EDGE}{WORD}(?: (?=\\p{{Lu}}))?+"


def session_key(spark: SparkSession) -> str:
    """The key of surrogates: ``spark.docdelta.pii.key``, or the one for the test tables."""
    return spark.conf.get("spark.docdelta.pii.key", None) or TEST_KEY


def has_entity(text: Column) -> Column:
    """Whether a text has an entity; cheap tests come first."""
    return (text.rlike("[0-9@\"']") & text.rlike(CODES)) | text.rlike(NAME)


def kind(m: Column) -> Column:
    """The type of a whole match."""
    return (
        F.when(m.rlike(f"^{NAME}$"), "name").when(m.rlike(f"^(?:{EMAIL})$"), "email").when(m.rlike(f"^(?:{HEX})$"), "hex").when(m.rlike(f"^(?:{KEY})$"), "key")
        .when(m.rlike(f"^(?:{IPV4})$"), "ipv4").when(m.rlike(f"^(?:{IPV6})$"), "ipv6").when(m.rlike(f"^(?:{SSN})$"), "ssn").when(m.rlike(f"^(?:{IBAN})$"), "iban")
        .when(m.rlike(f"^(?:{PHONE})$"), "phone").when(m.rlike(f"^(?:{CARD})$"), "card").otherwise("key")
    )


def _one_of(words: str, v: Column) -> Column:
    found = words.split()
    return F.element_at(F.array(*map(F.lit, found)), (v % len(found) + 1).cast("int"))


def units(m: Column) -> Column:
    """The entities of a match, array<struct<kind, key>>: one, or one for each word of a name (``given``, last ``surname``)."""
    bare = F.regexp_replace(m, f"^(?:{TITLE} )+", "")

    def words(found: Column) -> Column:
        return F.transform(found, lambda w, i: F.struct(F.when(i == F.size(found) - 1, "surname").otherwise("given").alias("kind"), w.alias("key")))

    def of(plain: Column) -> Column:
        key = (
            F.when(plain == "email", F.lower(m)).when(plain.isin("ssn", "card"), F.regexp_replace(m, "[^0-9]", ""))
            .when((plain == "phone") & m.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(m, r"^\+(\d{1,3})", 1), F.lit(" "), F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}", ""), "[^0-9]", "")))
            .when(plain == "phone", F.regexp_replace(m, "[^0-9]", "")).when(plain == "iban", F.replace(m, F.lit(" "), F.lit("")))
            .when(plain.isin("hex", "ipv6"), F.lower(m)).otherwise(m)
        )
        return F.when(plain == "name", let(F.split(bare, " "), words)).otherwise(F.array(F.struct(plain.alias("kind"), key.alias("key"))))

    return let(kind(m), of)


def vote(m: Column) -> Column:
    """The gender that a name's titles tell: m, f, or n for none."""
    says = lambda g: m.rlike(f"^(?:{TITLE} )*?(?:{'|'.join(TITLES[g])})[. ]")
    return F.when(m.rlike(f"^{NAME}$"), F.when(says("m"), "m").when(says("f"), "f").otherwise("n"))


def _stream(style: Column, key: Column, attempt: Column, secret: str) -> Column:
    seed = F.concat_ws("|", F.lit(secret), style, key, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f":{i}")), 512) for i in range(4)])


def _number(stream: Column, at) -> Column:
    return F.conv(F.substring(stream, F.lit(1) + (F.lit(at) if isinstance(at, int) else at) % 170 * 3, F.lit(3)), 16, 10).cast("int")


def _shaped(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """The text with each letter or digit replaced by one of its class, in one pass."""

    def char(c: Column, i: Column) -> Column:
        def of(v: Column) -> Column:
            pick = lambda letters: F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))
            return (
                F.when(c.between("0", "9"), pick("0123456789")).when(hexadecimal & c.between("a", "f"), pick("abcdef")).when(hexadecimal & c.between("A", "F"), pick("ABCDEF"))
                .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c < "\u0080", c).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
                .when(c.rlike(r"\p{L}"), pick("àâäçéèêëîïñôöùûü")).otherwise(c)
            )

        return let(_number(stream, i), of)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits; the number is valid if it is a multiple of ten."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def surrogate(style: Column, key: Column, attempt: Column, secret: str) -> Column:
    """The candidate replacement of one entity at one attempt. ``style`` is its kind; for names, kind:gender:script."""

    def of(stream: Column) -> Column:
        v = lambda i: _number(stream, i)
        more = F.substring(F.sha2(stream, 256), F.lit(1), F.greatest(attempt - GROWS, F.lit(0)))  # hexadecimal
        digits = F.translate(more, "abcdef", "012345")
        local, domain = F.substring_index(key, "@", 1), F.substring_index(key, "@", -1)
        site = F.concat(F.substring(F.sha2(F.concat(F.lit(secret), F.lit("|domain|"), domain), 256), 1, 8), F.lit(".example."), F.substring_index(domain, ".", -1))
        email = F.concat(_shaped(local, stream, F.lit(False)), more, F.lit("@d"), site)
        ipv4 = F.concat(F.concat_ws(".", *[(v(i) % 254 + 1).cast("string") for i in range(4)]), F.when(more != "", F.concat(F.lit("."), digits)).otherwise(""))
        drawn = _shaped(key, stream, F.lit(False))

        def checked(number: Column) -> Column:
            wrong = luhn(number) % 10
            return F.when(luhn(key) % 10 != 0, F.when(wrong != 0, number).otherwise(_changed_last(number, F.lit(1)))).otherwise(_changed_last(number, F.lit(10) - wrong))

        phone = F.concat(F.regexp_extract(key, r"^(?:\+\d+ )?", 0), _shaped(F.regexp_replace(key, r"^\+\d+ ", ""), stream, F.lit(False)), digits)
        iban = F.concat(F.substring(key, 1, 2), _shaped(F.substring(key, F.lit(3), F.length(key)), stream, F.lit(False)), digits)
        out = (
            F.when(style == "email", email).when(style == "ipv4", ipv4).when(style.isin("hex", "ipv6"), F.concat(_shaped(key, stream, F.lit(True)), more))
            .when(style == "card", let(F.concat(drawn, digits), checked)).when(style == "phone", phone).when(style == "iban", iban).when(style == "ssn", F.concat(drawn, digits))
        )
        gender, script = F.get(F.split(style, ":"), F.lit(1)), F.get(F.split(style, ":"), F.lit(2))
        for s, syllables in SYLLABLES.items():
            grown = F.concat(*[_one_of(syllables, v(20 + i)) for i in range(3)], *[F.when(attempt > 3 + i, _one_of(syllables, v(30 + i))).otherwise("") for i in range(12)])
            for g, ending in ENDINGS[s].items():
                made = F.initcap(F.concat(grown, F.lit(ending)))
                named = made if g == "s" else F.when(attempt == 0, _one_of(GIVEN[s][g], v(40))).otherwise(made)
                out = out.when((script == s) & (gender == g), named)
        return out.otherwise(F.concat(drawn, more))

    return let(_stream(style, key, attempt, secret), of)


def _changed_last(digits: Column, by: Column) -> Column:
    last = F.substring(digits, -1, 1).cast("int")
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((last + by) % 10).cast("string"))


def resolve(entities: DataFrame, secret: str, rounds: int = 40) -> DataFrame:
    """(kind, key, surrogate) for distinct ``entities`` (kind, key, style).

    No surrogate is given twice, or is itself an entity, among entities of one
    kind (names: of one script). Accepted surrogates are kept in one table that
    each round adds to, so plans don't grow with the rounds.
    """
    spark = entities.sparkSession
    script = F.element_at(F.split("style", ":"), -1)
    entities = materialize(entities.withColumn("space", script), "entities")
    taken = entities.select("space", F.col("key").alias("s")).distinct()
    accepted = new_folder(spark, "surrogates")
    schema = "kind string, key string, space string, surrogate string"
    pending = materialize(entities.withColumn("attempt", F.lit(0)), "pending")
    for k in range(rounds):
        drawn = pending.withColumn("s", surrogate(F.col("style"), F.col("key"), F.col("attempt"), secret))
        drawn = drawn.join(taken, ["space", "s"], "left_anti")
        if k:
            given = spark.read.schema(schema).parquet(*[f"{accepted}/{i}" for i in range(k)])
            drawn = drawn.join(given.select("space", F.col("surrogate").alias("s")), ["space", "s"], "left_anti")
        first = drawn.groupBy("space", "s").agg(F.min(F.struct("kind", "key")).alias("e"))
        first.select("e.kind", "e.key", "space", F.col("s").alias("surrogate")).write.parquet(f"{accepted}/{k}")
        good = spark.read.schema(schema).parquet(f"{accepted}/{k}").select("kind", "key")
        rest = materialize(pending.join(good, ["kind", "key"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "pending")
        drop_materialized(pending)
        pending = rest
        if pending.isEmpty():
            drop_materialized(entities)
            drop_materialized(pending)
            return spark.read.schema(schema).parquet(*[f"{accepted}/{i}" for i in range(k + 1)]).select("kind", "key", "surrogate")
    raise RuntimeError(f"surrogates still collide after {rounds} attempts")


def _written(m: Column, kind_: Column, core: Column) -> Column:
    """A match that is one entity, with its surrogate, in its own format and case.

    Runs of letters and digits take the surrogate's in turn (a format has few);
    what an exhausted space of values made longer comes at the end.
    """
    alnum = "^[0-9A-Za-z]"

    def cased(old: Column, new: Column) -> Column:
        mixed = F.array_join(F.zip_with(F.split(old, ""), F.split(new, ""), lambda a, b: F.when(a.between("A", "Z"), F.upper(b)).otherwise(b)), "")
        return F.when(old == F.upper(old), F.upper(new)).when(old == F.lower(old), new).otherwise(mixed)

    def woven(plain: Column) -> Column:
        def of(runs: Column) -> Column:
            length = lambda total, x: total + F.when(x.rlike(alnum), F.length(x)).otherwise(0)
            before = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), length)
            out = F.transform(runs, lambda x, i: F.when(x.rlike(alnum), cased(x, F.substring(plain, before(i) + 1, F.length(x)))).otherwise(x))
            return F.concat(F.array_join(out, ""), F.substring(plain, before(F.size(runs)) + 1, F.length(plain)))

        return let(F.regexp_extract_all(m, F.lit("[0-9A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0)), of)

    formatted = let(F.regexp_replace(core, "[^0-9A-Za-z]", ""), woven)
    return (
        F.when(kind_.isin("ssn", "phone", "card", "iban", "hex", "ipv6"), formatted)
        .when((kind_ == "email") & (F.upper(m) == m), F.upper(core)).otherwise(core)
    )


def pseudonymize(docs: DataFrame, secret: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the number of matches replaced in ``count_col``.

    ``secret`` keys the surrogates: the same key and corpus give the same ones.

    Defined cases: a null text stays null, an empty one empty (0 entities).
    Equal entities get equal surrogates in all rows and repeated rows. Texts
    without an entity return unchanged, byte for byte. A quoted secret without
    a letter or digit (a mask) is no entity. An entity may be as long as its
    text; it is read and written in one pass. Where a type has fewer values
    than the corpus has entities, surrogates grow longer than what they replace.
    Empty table: empty result. All columns return; ``count_col`` replaces one
    of that name, and helper columns live beside a struct of the row, so that
    no other name can clash.
    """
    columns = [c for c in docs.columns if c != count_col]
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("row")
    found = F.when(F.coalesce(has_entity(text), F.lit(False)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # The texts are written once, with what was found: patterns run over each text in one place only.
    scanned = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), row, found.alias("found")), "scanned")
    clean = scanned.where("found is null").select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.lit(0).alias(count_col))
    body = F.col(f"row.`{text_col}`")
    dirty = scanned.where("found is not null").withColumn("named", F.exists("found", lambda m: m.rlike(f"^{NAME}$")))
    every = lambda group: F.regexp_extract_all(body, F.lit(ANY_WORD), F.lit(group))
    coded = F.when(F.col("named"), F.transform(every(1), lambda m: m != "")).otherwise(F.transform("found", lambda m: F.lit(True)))
    matches = dirty.select("rid", F.posexplode(F.arrays_zip(F.when(F.col("named"), every(0)).otherwise(F.col("found")).alias("m"), coded.alias("coded"))).alias("pos", "x"))
    matches = matches.select("rid", "pos", F.col("x.m").alias("m"), F.col("x.coded").alias("coded"))
    parts = matches.where("coded").select("rid", "pos", "m", vote(F.col("m")).alias("vote"), F.posexplode(units(F.col("m"))).alias("j", "u"))
    parts = materialize(parts.select("rid", "pos", "m", "vote", "j", "u.kind", "u.key"), "entities")
    names = parts.where("kind IN ('given', 'surname')")
    roles = names.groupBy("rid", "key").agg(F.bool_or(F.col("kind") == "given").alias("given"), F.bool_or(F.col("kind") == "surname").alias("surname"))
    alone = matches.where("NOT coded").select("rid", "pos", "m", F.rtrim("m").alias("key")).join(roles, ["rid", "key"], "left")
    role = F.when(F.col("given") & (~F.col("surname") | F.col("m").endswith(" ")), "given").when(F.col("surname"), "surname")
    alone = materialize(alone.select("rid", "pos", "m", "key", role.alias("kind")), "words")

    genders = names.where("kind = 'given'").groupBy("key").agg(F.bool_or(F.col("vote") == "m").alias("m"), F.bool_or(F.col("vote") == "f").alias("f"))
    gender = F.when(F.col("kind") == "surname", "s").when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    script = F.when(F.col("key").rlike(r"\p{IsCyrillic}"), "Cyrillic").when(F.col("key").rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    entities = parts.select("kind", "key").distinct().join(genders, "key", "left")
    style = F.when(F.col("kind").isin("given", "surname"), F.concat_ws(":", "kind", gender, script)).otherwise(F.col("kind"))
    given = resolve(entities.select("kind", "key", style.alias("style")), secret)

    codes = parts.where("kind NOT IN ('given', 'surname')").join(given, ["kind", "key"]).select("rid", "pos", _written(F.col("m"), F.col("kind"), F.col("surrogate")).alias("w"), F.lit(1).alias("n"))
    single = alone.join(given, ["kind", "key"], "left")
    single = single.select("rid", "pos", F.coalesce(F.concat("surrogate", F.when(F.col("m").endswith(" "), " ").otherwise("")), "m").alias("w"), F.when(F.col("surrogate").isNull(), 0).otherwise(1).alias("n"))
    titled = names.join(given, ["kind", "key"]).groupBy("rid", "pos").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("j", "surrogate"))).alias("s"))
    titled = titled.select("rid", "pos", F.concat(F.regexp_extract("m", f"^(?:{TITLE} )+", 0), F.array_join(F.transform("s", lambda x: x["surrogate"]), " ")).alias("w"), F.lit(1).alias("n"))
    # Every match has one row, so its place in the list is its number in the text.
    lists = codes.unionByName(single).unionByName(titled).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("w"), F.sum("n").cast("int").alias("n"))
    pieces = F.when(F.col("named"), F.split(body, ANY_WORD)).otherwise(F.split(body, PATTERN))
    new_text = let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("w"), i), F.lit("")))), ""))
    out = dirty.join(lists, "rid").select("row", new_text.alias("new_text"), "n")
    return clean.unionByName(out.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns], F.col("n").alias(count_col)))
