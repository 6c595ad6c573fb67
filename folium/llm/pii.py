"""Surrogates for personal data, with built-in functions only.

Entities are found by one pattern. Each distinct entity (kind and normal form) gets a surrogate
from a keyed hash: characters are replaced class by class, so that format, length and letter case stay,
addresses become addresses, and names become names of the same gender and script. A given name and a family name
are entities of their own, so `Mr. John Smith` and `Mr. Smith` keep one family name; the feminine ending of a Cyrillic family name
is put aside and added again. The table of all entities is then checked: where two would share a surrogate, or a surrogate is
a real entity of any kind, the later one draws again until none is left. Every third draw makes the surrogate longer by one
(letter of the address, digit, part of the name, or a port), so the draws have an end however many entities there are.
So one entity has one surrogate in all documents, and two have two.
Mentions are put back into the texts in the spelling of the mention.

Names are found after a title only.

Cases: null and empty texts have no entities and stay; texts without entities stay as they are; very long texts are one row each; repeated rows get
equal texts; a null doc_id is kept; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

#: How each kind is written, and titles and names by gender and script.
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A plus and 7 to 15 digits, in groups of any number and size, one of the first in brackets if any; no group after a space begins another entity. Then shorter ones, and those without a plus.
_GAP = rf"(?: (?!{CARD}|{SSN}|{IP})|[.-])?"
PHONE = rf"\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)(?:{_GAP}[0-9]){{4,12}}(?![0-9])|\+[0-9](?:{_GAP}[0-9]){{6,14}}(?![0-9])|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-][0-9]{{2,4}}){{1,3}}(?![0-9])|(?<![0-9])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}(?![0-9])"
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Г-жа"]
#: Syllables that names are made of, by script; any start, middle and end make a name.
STARTS = {
    "latin": "Al Bar Ben Bran Cal Dal Dor El Fal Gar Hal Har Jan Kel Lan Lor Mar Mel Nor Or Per Ral Ros Sal Sel Tal Tor Ul Val Ver Wal Wen".split(),
    "cyrillic": "Бар Бел Вор Гал Гор Дар Дол Зар Кал Кор Лаз Мал Мир Нор Пан Пол Рад Рос Сав Сок Тар Тул Хар Чер".split(),
}
MIDDLES = {"latin": ["", *"a e i o an en in on er ar is and est ing olt".split()], "cyrillic": ["", *"а е и о ан ен ин он ар ер ор ас ес ист ол".split()]}
ENDS = {
    "latin": {
        "m ": "bert dan dric fred gus ian mond nard neth rick ton vin ward win wyn zar".split(),
        "f ": "bella dora elle etta gard ia ine issa linda lotte mina nora ria rose sia tha".split(),
        "": "berg den feld ford gard ham hurst land ley lund man mer mond nell ner roth sen ser son stad stein stone ton vall ven vik ville wall well wick wood worth".split(),
    },
    "cyrillic": {
        "m ": "слав мир рий лий ний тин дан лад мил рад сей вей гей дей лей мен".split(),
        "f ": "слава мира рия лия ния тина дана лада мила рада сея вея гея дея лея мена".split(),
        "": "ков лов нов ров сов тов ин кин лин нин шин цев чев няев дов бов".split(),
    },
}

_TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{Ll}}'-]+(?: (?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}[\p{{Ll}}'-]+)?"
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD, "name": NAME}
ANY = "|".join(KINDS.values())
#: For texts without an @, which are most, the kinds by what they start with.
_CAPITALS = "".join(sorted({t[0] for t in MALE + FEMALE}))
_REST = rf"(?=[0-9+(])(?:{SECRET}|{IP}|{PHONE}|{SSN}|{CARD})|(?=[A-Fa-f]){SECRET}|(?=[{_CAPITALS}]){NAME}"


def find(text: Column) -> Column:
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains("@"), found(ANY)).otherwise(found(_REST))


def _has(text: Column) -> Column:
    return F.coalesce(F.when(text.contains("@"), text.rlike(ANY)).otherwise(text.rlike(_REST)), F.lit(False))


def kind_of(mention: Column) -> Column:
    out = F.lit("card")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def normal(kind: Column, mention: Column) -> Column:
    """Spellings of one entity have one normal form; of a phone number, the part after the country code alone is replaced."""
    name = F.concat(_gender(mention), F.lower(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")))
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9+]", "")).when(kind == "name", name).otherwise(F.lower(mention))


def _gender(mention: Column) -> Column:
    return F.when(mention.rlike(rf"^(?:{'|'.join(MALE)})[. ]"), "m ").otherwise("f ")


def _stream(key: str, kind: Column, norm: Column, tries: Column, size: Column) -> Column:
    """At least `size` keyed hex pairs."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, norm, tries.cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("\u0001"), k.cast("string")), 256)), "")


def _drawn(stream: Column, i: Column) -> Column:
    """The i-th pair as a number."""
    return F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def surrogate(kind: Column, norm: Column, stream: Column, extra: Column) -> Column:
    """The normal form of what replaces an entity: drawn from the keyed stream, and longer by `extra`."""
    chars = F.split(norm, "")
    digits, letters, hexes = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    more = lambda alphabet: F.array_join(F.when(extra > 0, F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda k: _letter(alphabet, _drawn(stream, F.length(norm) + k)))).otherwise(F.array().cast("array<string>")), "")
    tail = F.length(norm) - F.length(F.substring_index(norm, ".", -1))
    mail = F.concat(more(letters), F.array_join(F.transform(chars, lambda c, i: F.when(i >= tail, c).when(c.rlike("[0-9]"), _letter(digits, _drawn(stream, i))).when(c.rlike("[a-z]"), _letter(letters, _drawn(stream, i))).otherwise(c)), ""))
    secret = F.concat(F.array_join(F.transform(chars, lambda c, i: _letter(hexes, _drawn(stream, i))), ""), more(hexes))
    #: The country code stays: up to three digits, as many as leave ten.
    kept = F.when((kind == "phone") & norm.startswith("+"), F.greatest(F.least(F.length(norm) - 10, F.lit(4)), F.lit(2))).otherwise(0)
    number = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(i < kept, c).when((i == kept) & (kind != "ssn"), _letter("123456789", _drawn(stream, i))).otherwise(_letter(digits, _drawn(stream, i)))), ""), more(digits))
    port = F.when(extra > 0, F.concat(F.lit(":"), (1024 + _drawn(stream, F.lit(8)) * 250 + _drawn(stream, F.lit(9)) % 250).cast("string"))).otherwise("")
    address = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_drawn(stream, i) % 254 + 1).cast("string")), "."), port)
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "ip", address).when(kind.isin("given", "family"), _name(norm, stream, extra)).when(kind == "secret", secret).otherwise(mail)


def _name(norm: Column, stream: Column, extra: Column) -> Column:
    """A name in lower case, of `extra` parts more than one: of a given name, after its gender mark."""
    pick = lambda of, k: F.element_at(F.array(*map(F.lit, of)), ((_drawn(stream, k) * 256 + _drawn(stream, k + 1)) % len(of) + 1).cast("int"))

    def made(script: str, mark: str) -> Column:
        part = lambda k: F.concat(pick(STARTS[script], 6 * k), pick(MIDDLES[script], 6 * k + 2), pick(ENDS[script][mark], 6 * k + 4))
        return F.concat(F.lit(mark), F.lower(F.array_join(F.transform(F.sequence(F.lit(0), extra), part), "-")))

    of = lambda script: F.when(norm.startswith("m "), made(script, "m ")).when(norm.startswith("f "), made(script, "f ")).otherwise(made(script, ""))
    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _with_parts(names: DataFrame) -> DataFrame:
    """names (norm) with given (null if there is one part) and family, the entities of their parts, and ending, what is put after the family name."""
    p = F.split("norm", " ")
    last = F.element_at(p, -1)
    feminine = F.col("norm").startswith("f ") & last.rlike(r"^\p{IsCyrillic}{2,}а$")
    given = F.when(F.size(p) > 2, F.concat_ws(" ", p[0], p[1]))
    return names.withColumns({"given": given, "family": F.when(feminine, F.substring(last, F.lit(1), F.length(last) - 1)).otherwise(last), "ending": F.when(feminine, F.lit("а")).otherwise("")})


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """kind, norm, sub: distinct entities and their surrogates, no two alike and none that is an entity."""
    n = mentions.count()
    known = staged(mentions.select("kind", "norm").distinct(), "pii-known", rows=n)
    names = staged(_with_parts(known.filter("kind = 'name'")), "pii-names", rows=n)
    parts = names.select(F.explode(F.array(F.struct(F.lit("given").alias("kind"), F.col("given").alias("norm")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("norm")))).alias("p")).select("p.*").filter("norm is not null").distinct()
    drawn = _distinct(known.filter("kind <> 'name'").unionByName(parts), key, n)
    family = names.join(drawn.filter("kind = 'family'").select(F.col("norm").alias("family"), F.col("sub").alias("last")), "family")
    with_given = family.filter("given is not null").join(drawn.filter("kind = 'given'").select(F.col("norm").alias("given"), F.col("sub").alias("first")), "given")
    last = F.concat("last", "ending")
    two = with_given.select("kind", "norm", F.concat_ws(" ", F.substring("first", 3, 1000), last).alias("sub"))
    return drawn.filter("kind not in ('given', 'family')").select("kind", "norm", "sub").unionByName(family.filter("given is null").select("kind", "norm", last.alias("sub"))).unionByName(two)


def _distinct(units: DataFrame, key: str, n: int) -> DataFrame:
    """units (kind, norm) with sub: drawn until no two are alike and none is a unit."""
    units = staged(units, "pii-units", rows=n)
    drawn = staged(_draw(units.withColumn("tries", F.lit(0)), key), "pii-drawn", rows=n)
    real = units.select(F.col("norm").alias("sub")).distinct()
    while True:
        first = F.row_number().over(Window.partitionBy("sub").orderBy("tries", "kind", "norm"))
        clash = drawn.withColumn("rank", first).join(real.withColumn("real", F.lit(True)), "sub", "left")
        again = staged(clash.filter("rank > 1 or real").select("kind", "norm", "tries"), "pii-again", rows=n)
        if again.isEmpty():
            return drawn
        kept = drawn.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti")
        drawn = staged(kept.unionByName(_draw(again.withColumn("tries", F.col("tries") + 1), key)), "pii-drawn", rows=n)


def _draw(rows: DataFrame, key: str) -> DataFrame:
    extra = F.floor(F.col("tries") / 3).cast("int")
    stream = _stream(key, F.col("kind"), F.col("norm"), F.col("tries"), F.length("norm") + 6 * extra + 16)
    return rows.withColumn("_stream", stream).withColumn("sub", surrogate(F.col("kind"), F.col("norm"), F.col("_stream"), extra)).drop("_stream")


def spelled(kind: Column, mention: Column, sub: Column) -> Column:
    """The surrogate in the mention's spelling; what it is longer by goes before an address and after a number."""
    chars = F.split(mention, "")
    plain = lambda c: F.length(F.regexp_replace(c, "[^0-9+]", ""))
    number = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9+]"), F.substring(sub, plain(F.substring(mention, F.lit(1), i)) + 1, F.lit(1))).otherwise(c)), ""), F.substring(sub, plain(mention) + 1, F.length(sub)))
    before = F.length(sub) - F.length(mention)
    cased = F.array_join(F.transform(F.split(sub, ""), lambda c, i: F.when((i >= before) & F.get(chars, F.greatest(i - before, F.lit(0))).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    cased = F.when((kind == "secret") & (F.upper(mention) == mention), F.upper(sub)).when(kind == "secret", sub).otherwise(cased)
    name = F.concat(F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0), F.regexp_replace(F.initcap(F.regexp_replace(sub, "-", "- ")), "- ", "-"))
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "ip", sub).when(kind == "name", name).otherwise(cased)


def replace_entities(docs: DataFrame, key: str = "folium") -> DataFrame:
    """docs with text replaced, and n_entities and kinds (sorted, distinct) in place of columns of these names."""
    cols = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    marked = docs.select(*cols).withColumns({"_hit": _has(F.col("text")), "_a": F.xxhash64("text"), "_b": F.hash("text")})
    hits = staged(marked.filter("_hit").select("_a", "_b", "text").dropDuplicates(["_a", "_b"]).select("_a", "_b", F.posexplode_outer(find(F.col("text"))).alias("at", "mention")), "pii-mentions")
    told = hits.withColumn("kind", kind_of(F.col("mention"))).withColumn("norm", normal(F.col("kind"), F.col("mention")))
    table = small(entities(told, key).select("kind", "norm", "sub"))
    put = told.join(table, ["kind", "norm"]).select("_a", "_b", "kind", F.struct("at", spelled(F.col("kind"), F.col("mention"), F.col("sub")).alias("by")).alias("m"))
    lists = staged(put.groupBy("_a", "_b").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["by"]).alias("by"), F.sort_array(F.collect_set("kind")).alias("kinds")), "pii-by-text")
    rest = F.when(F.col("text").contains("@"), F.split("text", ANY, -1)).otherwise(F.split("text", _REST, -1))
    joined = F.array_join(F.flatten(F.zip_with(rest, "by", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    none = F.array().cast("array<string>")
    clean = marked.filter("not _hit").select(*cols, F.lit(0).cast("bigint").alias("n_entities"), none.alias("kinds"))
    done = marked.filter("_hit").join(lists, ["_a", "_b"]).select(*[joined.alias("text") if c == "text" else F.col(c) for c in cols], F.size("by").cast("bigint").alias("n_entities"), "kinds")
    return clean.unionByName(done)
