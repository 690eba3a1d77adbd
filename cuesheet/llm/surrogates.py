"""Surrogates for personal data.

Mentions of e-mail addresses, telephone numbers, IP addresses, social security numbers, IBANs, long card or account numbers
and titled names are found by one pattern. A mention's entity is its normal form: digits without separators, lower case. Each distinct entity draws a
surrogate of its own type from a keyed digest; draws that two entities share, or that are themselves an entity of the
corpus, are drawn again until all are distinct. The surrogate then takes the mention's format, so a number keeps its
separators, a name its title, gender, script and capitals. Names are replaced word by word, so a shorter mention of a person
gets the same words as the full one, and words of a titled name are replaced without title too in that document. Everything is built of column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.vectors import let
from cuesheet.operators import skew
from cuesheet.session import materialise

# Titles that introduce a name, by gender and script, and the syllables surrogate names are made of.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Mlle", "Madame", "Lady", "Dame"]
MALE = ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Sir", "Lord"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Doktor", "Mx", "Rev"]
FEMALE_CYRILLIC = ["г-жа", "госпожа"]
MALE_CYRILLIC = ["г-н", "господин"]
NEUTRAL_CYRILLIC = ["д-р", "доктор", "профессор"]
TITLES = "(?:" + "|".join(sorted([*FEMALE, *MALE, *NEUTRAL, *FEMALE_CYRILLIC, *MALE_CYRILLIC, *NEUTRAL_CYRILLIC], key=len, reverse=True)) + ")\\.?+ "
NO_NAMES = ["The", "And", "But", "He", "She", "It", "They", "We", "You", "In", "On", "At", "This", "That", "Is", "Was", "Who", "When", "Der", "Die",
            "Das", "Und", "Er", "Sie", "El", "Los", "Las", "Y", "Et", "Les", "Il", "Elle"]
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FO FI GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM BI DJ",
                28: "AL AZ BY CY DO GT HU LB PL SV NI HN", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
LATIN = ["ba", "den", "lo", "mar", "ri", "sel", "tan", "vo", "ka", "lin", "no", "per", "sta", "wil", "ha", "jo"]
CYRILLIC = ["ба", "ден", "ло", "мар", "ри", "сел", "тан", "во", "ка", "лин", "но", "пер", "ста", "вил", "ха", "жо"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = rf"(?<!\d)(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
NATIONAL = r"(?<![\w+.-])(?:(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\(?0\d{1,4}\)?(?:[ /.-]\d{2,4}){3,4}|\(?0\d{2,5}\)?[ /-]\d{5,8})(?![\w]|[.-]\d)"
SSN = r"(?<![\w.-])(?!000|666|9)\d{3}([ -])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-]|\.\d)"
IBAN = r"(?<!\w)(?:" + "|".join(rf"(?:{c.replace(' ', '|')})\d\d(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?!\w)"
_HEXTET = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEXTET}:){{7}}{_HEXTET}|{_HEXTET}(?::{_HEXTET}){{0,6}}::(?:{_HEXTET}(?::{_HEXTET}){{0,6}})?)(?![\w:]|\.\d)"
NUMBER = r"(?<!\w)(?<!\d\.)\d(?:[ -]?\d){12,18}(?!\d)"
_WORD = "\\p{Lu}[\\p{L}\\p{M}]++(?:['’-]\\p{Lu}[\\p{L}\\p{M}]++)*+"
WORD = "(?<![\\p{L}\\p{M}])(?:\\p{Lu}['’])?" + _WORD
_NAME_WORD = "(?!(?:" + "|".join(NO_NAMES) + ")(?!\\p{L}))(?:(?:\\p{Lu}['’])?" + _WORD + "|\\p{Lu}\\.(?= \\p{Lu}))"
NAME = f"(?<![\\p{{L}}])(?:{TITLES})++{_NAME_WORD}(?: (?:(?:von|van|de|del|der|den|la|di|da|bin|al) ){{0,2}}{_NAME_WORD})*+"
SSN = SSN.replace("([ -])", "(?:-(?=\\d\\d-)| (?=\\d\\d ))").replace(r"\1", "[ -]")
MENTION = "|".join([EMAIL, IP6, IP, PHONE, IBAN, SSN, NATIONAL, NUMBER, NAME])
GENDERS = ("female", "male", "neutral", "female_cyrillic", "male_cyrillic", "neutral_cyrillic")
TYPES = ("email", "ip", "ip6", "phone", "national", "ssn", "iban", "number", *GENDERS)
#: Draws after which a surrogate grows by a character, or leaves the prefix of its address, and again after as many.
PATIENCE = 12


def mentions(text: Column) -> Column:
    """All mentions in order; a cheap look for a sign that every mention has comes first."""
    found = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    return F.when(text.rlike(rf"@|\d\.\d|\d[ -]?\d|::|\d:|{TITLES}\p{{Lu}}"), found).otherwise(F.array().cast("array<string>"))


def kind(mention: Column) -> Column:
    titles = F.regexp_extract(mention, rf"^(?:{TITLES})+", 0)

    def has(*lists: list[str]) -> Column:
        return titles.rlike(r"(?:^| )(?:" + "|".join(w for x in lists for w in x) + r")[. ]")

    gender = F.when(has(FEMALE), "female").when(has(MALE), "male").when(has(FEMALE_CYRILLIC), "female_cyrillic").when(has(MALE_CYRILLIC), "male_cyrillic") \
        .when(has(NEUTRAL), "neutral").otherwise("neutral_cyrillic")
    return F.when(mention.contains("@"), "email").when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$") & mention.rlike(f"^{IP}$"), "ip").when(mention.startswith("+"), "phone") \
        .when(mention.rlike(r"^[0-9A-Fa-f]+:"), "ip6").when(mention.rlike(r"^[A-Z]{2}\d\d"), "iban").when(mention.rlike(r"^\d{3}[ -]\d\d[ -]\d{4}$"), "ssn") \
        .when(mention.rlike(r"^[\d(]"), F.when((F.length(F.regexp_replace(mention, r"\D", "")) >= 13), "number").otherwise("national")).otherwise(gender)


def name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, rf"^(?:{TITLES})+", ""), " ")


def _is_name_word(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def _word_form(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"\.$", ""))


def _hextets(mention: Column) -> Column:
    """Eight groups of four digits; a double colon stands for as many zeros as are missing."""
    sides = F.split(F.lower(mention), "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda h: h != "") for i in (0, 1))
    return F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right), lambda h: F.lpad(h, 4, "0"))


def entities(mention: Column) -> Column:
    """``type:normal form``, equal for all mentions of one entity; of a name, that of each of its words."""
    k = kind(mention)
    normal = F.when(k.isin("phone", "national", "ssn", "number"), F.regexp_replace(mention, r"\D", "")).when(k == "ip6", F.array_join(_hextets(mention), ":")) \
        .when(k == "iban", F.lower(F.regexp_replace(mention, "[ -]", ""))).otherwise(F.lower(mention))
    words = F.transform(F.filter(name_words(mention), _is_name_word), lambda w: F.concat(k, F.lit(":"), _word_form(w)))
    return F.when(k.isin(*GENDERS), words).otherwise(F.array(F.concat(k, F.lit(":"), normal)))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal digest of 32 bytes, taken round."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _characters(text: Column, digest: Column) -> Column:
    """Every letter and digit moved within its own kind by a byte of the digest, all else as it is.

    The digest is refreshed for every 32 characters, so that a long entity does not repeat its shifts.
    """
    def moved(c: Column, i: Column) -> Column:
        v = _byte(F.sha2(F.concat(digest, F.floor(i / 32).cast("string")), 256), i)
        code = F.ascii(c)
        return F.when(c.rlike("^[0-9]$"), F.pmod(code - 48 + v, F.lit(10)).cast("string")) \
            .when(c.rlike("^[a-z]$"), F.char(F.pmod(code - 97 + v, F.lit(26)) + 97)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum of a string of digits; a valid card number's is a multiple of ten."""
    def step(at: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((at["s"] + F.when(at["odd"], d).otherwise(twice)).alias("s"), (~at["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("s"), F.lit(True).alias("odd"))
    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), start, step, lambda s: s["s"])


def _number(digits: Column, digest: Column, longer: Column) -> Column:
    """First digit kept, the others moved; a valid check digit stays valid and an invalid one invalid."""
    moved = _characters(F.concat(F.substring(digits, F.lit(2), F.length(digits) - 2), F.repeat(F.lit("0"), longer)), digest)
    body = F.concat(F.left(digits, F.lit(1)), moved)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    wrong = F.pmod(check + 1 + F.pmod(_byte(digest, F.lit(31)), F.lit(9)), F.lit(10))
    valid = F.pmod(luhn_sum(digits), F.lit(10)) == 0
    return F.concat(body, F.when(valid, check).otherwise(wrong).cast("string"))


def iban_rest(iban: Column) -> Column:
    """Remainder of a lower-case IBAN, its first four characters moved to the end and letters read as numbers; 1 where it is valid."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.left(iban, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c == "", rest).when(c.rlike("^[0-9]$"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 87) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(normal: Column, digest: Column) -> Column:
    """Country and length kept; valid check digits stay valid and others invalid."""
    country, body = F.left(normal, F.lit(2)), _characters(F.substring(normal, F.lit(5), F.length(normal)), digest)
    right = F.lit(98) - iban_rest(F.concat(country, F.lit("00"), body))
    wrong = F.pmod(right + 1 + F.pmod(_byte(digest, F.lit(31)), F.lit(96)), F.lit(97))
    return F.concat(country, F.lpad(F.when(iban_rest(normal) == 1, right).otherwise(wrong).cast("string"), 2, "0"), body)


def _ip6(normal: Column, digest: Column, longer: Column) -> Column:
    """The first group and groups of zeros are kept; the others keep their length."""
    def group(h: Column, i: Column) -> Column:
        size = F.least(F.lit(4), F.length(F.regexp_replace(h, "^0+", "")) + longer)
        own = F.sha2(F.concat(digest, i.cast("string")), 256)
        first = F.substring(F.lit("123456789abcdef"), F.pmod(_byte(own, F.lit(0)), F.lit(15)).cast("int") + 1, F.lit(1))
        return F.when((i == 0) | (h == "0000"), h).otherwise(F.lpad(F.concat(first, F.substring(own, F.lit(3), size - 1)), 4, "0"))

    return F.array_join(F.transform(F.split(normal, ":"), group), ":")


def _ip(normal: Column, digest: Column, longer: Column) -> Column:
    """Private addresses stay private: their first octets are kept. A full network moves on to 10.0.0.0, then to any address."""
    network = F.when(normal.startswith("10.") | normal.startswith("127."), 1).when(
        normal.startswith("192.168.") | normal.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), 2).otherwise(0)
    octets = F.split(F.when((network == 2) & (longer > 0), F.regexp_replace(normal, r"^\d+", "10")).otherwise(normal), r"\.")
    keep = F.when(longer > 1, 0).when((network == 2) & (longer > 0), 1).otherwise(network)
    return F.array_join(F.transform(octets, lambda o, i: F.when(i < keep, o).otherwise((F.pmod(_byte(digest, i) * 7 + _byte(digest, i + 8), F.lit(223)) + 1).cast("string"))), ".")


def _name(k: Column, normal: Column, digest: Column, attempt: Column) -> Column:
    """As many name parts as the original, of syllables of its script with an ending of its gender; longer with each attempt."""
    cyrillic = k.endswith("cyrillic")
    def part(i: Column) -> Column:
        count = F.least(F.lit(3) + attempt, F.lit(12))
        own = F.sha2(F.concat(digest, F.lit("n"), i.cast("string")), 256)
        body = F.transform(F.sequence(F.lit(0), count - 1), lambda j: let(F.pmod(_byte(own, j), F.lit(16)), lambda at: F.when(
            cyrillic, F.get(F.array(*map(F.lit, CYRILLIC)), at)).otherwise(F.get(F.array(*map(F.lit, LATIN)), at))))
        ending = F.when(k == "female", "a").when(k == "male", "o").when(k == "neutral", "e") \
            .when(k == "female_cyrillic", "а").when(k == "neutral_cyrillic", "енко").otherwise("ов")
        return F.concat(F.array_join(body, ""), ending)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split(normal, " ")) - 1), part), " ")


def draw(name: Column, attempt: Column, key: str) -> Column:
    """The surrogate, again as ``type:normal form``, that an entity draws at an attempt."""
    k, normal = F.substring_index(name, ":", 1), F.substring(name, F.instr(name, F.lit(":")) + 1, F.length(name))
    digest = F.sha2(F.concat(F.lit(f"{key}|"), attempt.cast("string"), F.lit("|"), name), 256)
    at, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    longer = F.floor(attempt / PATIENCE).cast("int")
    more = F.repeat(F.lit("0"), longer)
    email = F.concat(_characters(F.concat(at, F.repeat(F.lit("a"), longer)), digest), F.lit("@"), _characters(host, F.sha2(digest, 256)), F.lit("."), ending)
    new = F.when(k == "email", email).when(k == "ip", _ip(normal, digest, longer)).when(k == "ip6", _ip6(normal, digest, longer)).when(k == "iban", _iban(normal, digest)).when(
        k.isin("phone", "national", "ssn"), F.concat(F.left(normal, F.lit(1)), _characters(F.concat(F.substring(normal, F.lit(2), F.length(normal)), more), digest))) \
        .when(k == "number", _number(normal, digest, longer)).otherwise(_name(k, normal, digest, attempt))
    return F.concat(k, F.lit(":"), new)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``(entity, surrogate)`` for distinct entities: all surrogates distinct, and none an entity itself.

    Collisions are counted over the whole table. Of the entities that drew the same, the least keeps its draw; the
    others, and those that hit an entity, draw again. Only these are looked at in the next round. A format that has no room
    left grows by a character.
    """
    known = materialise(entities.select("entity").distinct())
    accepted, waiting, attempt = None, known, 0
    while True:
        drawn = materialise(waiting.select("entity", draw(F.col("entity"), F.lit(attempt), key).alias("surrogate")))
        first = drawn.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        taken = known.select(F.col("entity").alias("surrogate"))
        if accepted is not None:
            taken = taken.union(accepted.select("surrogate"))
        good = materialise(first.join(taken.hint("merge"), "surrogate", "left_anti").select("entity", "surrogate"))
        accepted = good if accepted is None else materialise(accepted.union(good))
        waiting = materialise(waiting.join(good.hint("merge"), "entity", "left_anti"))
        if waiting.isEmpty():
            return accepted
        attempt += 1


def _value(surrogate: Column) -> Column:
    return F.substring(surrogate, F.instr(surrogate, F.lit(":")) + 1, F.length(surrogate))


def _capitals(word: Column, new: Column) -> Column:
    return F.when(word.rlike(r"^\p{Lu}\.$"), F.concat(F.upper(F.left(new, F.lit(1))), F.lit("."))) \
        .when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(F.initcap(new))


def word_surrogate(word: Column, table: Column, *kinds: str) -> Column:
    """What the document's table has for a word of a name under the first of the kinds; null where it has none."""
    return F.coalesce(*[F.try_element_at(table, F.concat(F.lit(f"{k}:"), _word_form(word))) for k in kinds])


def formatted(mention: Column, table: Column) -> Column:
    """The surrogate of a mention by the document's table, in the format of the mention."""
    k = kind(mention)
    normal = _value(F.try_element_at(table, F.get(entities(mention), F.lit(0))))
    filled = F.aggregate(
        F.split(mention, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9A-Z]$"), F.struct(F.concat(s["t"], F.upper(F.substring(normal, s["i"], F.lit(1)))).alias("t"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))), lambda s: F.concat(s["t"], F.substring(normal, s["i"], F.length(normal))))
    groups = F.filter(F.split(normal, ":"), lambda h: h != "0000")
    ip6 = F.aggregate(
        F.split(mention, ":"), F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("i")),
        lambda s, h: F.when(h.rlike("^0*$"), F.struct(F.concat(s["t"], F.array(h)).alias("t"), s["i"].alias("i"))).otherwise(F.struct(F.concat(
            s["t"], F.array(let(F.regexp_replace(F.get(groups, s["i"]), "^0+", ""), lambda g: F.lpad(g, F.greatest(F.length(g), F.length(h)), F.lit("0"))))).alias("t"),
            (s["i"] + 1).alias("i"))), lambda s: F.array_join(s["t"], ":"))
    email = F.when(mention == F.upper(mention), F.upper(normal)).otherwise(normal)

    def named(w: Column) -> Column:
        def new(*kinds: str) -> Column:
            return _value(word_surrogate(w, table, *kinds))

        other = F.when(k == "neutral", new("female", "male", "neutral")).otherwise(new("female_cyrillic", "male_cyrillic", "neutral_cyrillic"))
        own = _value(F.try_element_at(table, F.concat(k, F.lit(":"), _word_form(w))))
        return F.when(_is_name_word(w), _capitals(w, F.when(k.startswith("neutral"), other).otherwise(own))).otherwise(w)

    name = F.concat(F.regexp_extract(mention, rf"^(?:{TITLES})+", 0), F.array_join(F.transform(name_words(mention), named), " "))
    return F.when(k.isin("phone", "national", "ssn", "number", "iban"), filled).when(k == "ip", normal).when(
        k == "ip6", F.when(mention.rlike("[A-F]"), F.upper(ip6)).otherwise(ip6)).when(k == "email", email).otherwise(name)


def bare_words(gap: Column, table: Column) -> Column:
    """A text between mentions, with the words of the document's titled names replaced."""
    def new(w: Column) -> Column:
        return let(_value(word_surrogate(w, table, *GENDERS)), lambda v: F.when(v.isNotNull(), _capitals(w, v)).otherwise(w))

    return let(F.split(gap, WORD, -1), lambda g: F.concat(F.get(g, F.lit(0)), F.array_join(F.transform(
        F.regexp_extract_all(gap, F.lit(WORD), F.lit(0)), lambda w, i: F.concat(new(w), F.get(g, i + 1))), "")))


def replace_personal_data(docs: DataFrame, key: str = "surrogate") -> DataFrame:
    """``(doc_id, text, n_entities, n_mentions)`` for every row of ``documents``, every mention replaced.

    The same entity has the same surrogate in all documents, two entities never share one. A text without mentions is
    returned as it is, null and empty ones too. Repeated rows are changed alike; a null doc_id stays null; no rows give
    no rows; other columns are ignored. Only documents with mentions are joined, by doc_id and a digest of their text;
    a hot entity's rows are dealt out by the salted join. Counted are mentions by pattern, and of names with one surname
    under one gender the longer ones.
    """
    found = docs.select("doc_id", "text", mentions(F.col("text")).alias("_m"))
    with_any = found.where(F.size("_m") > 0).select("doc_id", "text", F.sha2(F.col("text"), 256).alias("_text"))
    slim = materialise(found.where(F.size("_m") > 0).select(
        F.sha2(F.col("text"), 256).alias("_text"), F.flatten(F.transform("_m", entities)).alias("_e")).dropDuplicates(["_text"]).select(
        "_text", F.explode(F.array_distinct("_e")).alias("entity")))
    table = surrogate_table(slim, key)
    counts = slim.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    named = skew.salted_lookup(slim, table, ["entity"], counts, "_n", ["_text"])
    maps = named.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"))
    joined = with_any.join(maps.hint("merge"), "_text")
    names = F.exists(F.map_keys("_map"), lambda e: F.substring_index(e, ":", 1).isin(*GENDERS))
    plain = F.split("text", MENTION, -1)
    gaps = F.when(names, F.transform(plain, lambda g: bare_words(g, F.col("_map")))).otherwise(plain)
    filled = F.transform(mentions(F.col("text")), lambda m: formatted(m, F.col("_map")))
    whole = F.array_distinct(F.transform(mentions(F.col("text")), lambda m: F.array_join(entities(m), " ")))
    persons = F.filter("_whole", lambda e: ~F.exists("_whole", lambda o: o.endswith(F.concat(F.lit(" "), e))))
    changed = let(gaps, lambda g: let(filled, lambda f: F.concat(
        F.get(g, F.lit(0)), F.array_join(F.transform(f, lambda x, i: F.concat(x, F.get(g, i + 1))), ""))))
    done = joined.withColumn("_whole", whole).select("doc_id", changed.alias("text"), F.size(persons).cast("bigint").alias("n_entities"),
                         F.size(mentions(F.col("text"))).cast("bigint").alias("n_mentions"))
    zero = F.lit(0).cast("bigint")
    rest = found.where(F.coalesce(F.size("_m"), F.lit(0)) <= 0).select("doc_id", "text", zero.alias("n_entities"), zero.alias("n_mentions"))
    return done.union(rest)
