"""Personal data replaced by surrogates.

Entities are found by one pattern. Each entity, in a canonical form that all its
spellings share, gets one surrogate from a keyed hash: the same everywhere (coreference),
of the same kind and form. Digits stay digits in their places and groups, valid card
numbers stay valid, country codes and top-level domains are kept, names keep script and
case and the gender their title tells. A person whom a document names once with a title
has the same surrogate there without it, with another title and in parts. Two entities of
a kind never share a surrogate and no surrogate is an entity of the texts: surrogates that
fail this check are drawn again, with the number of the attempt in the hash, until none
fails.

Built-in expressions, joins and grouping only. Surrogates are computed once per distinct
entity; only documents with entities meet them in a join.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import free, read_table, stored

KEY = "logmill"
# From this attempt on, the form gives way to distinctness: where texts hold (nearly) all
# entities of a form, no other one is left. Each attempt has so many more characters.
WIDER, MORE = 10, 12

# Titles before names, by the gender they tell.
MALE = ["Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor"]

_WORD = r"\p{L}\p{N}"
# A capitalised word with marks, hyphens and apostrophes inside, or an initial before another.
_NAME_WORD = r"\p{Lu}(?:\.(?= \p{Lu}[\p{L}\p{M}.])|[\p{L}\p{M}]*+(?:(?:-|['’](?!s(?!\p{L})))\p{L}[\p{L}\p{M}]*+)*+)"
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
# Kind, pattern; the first that matches at a place counts. Loops give nothing back, or are
# bounded by what the form allows (a domain has at most 253 characters and labels of 63), so
# that no text takes more than linear time or a deep stack.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}][{_WORD}._%+-]*+@[{_WORD}](?:[{_WORD}-]{{0,63}}+\.){{1,126}}\p{{L}}{{2,24}}",
    "secret": rf"(?<![{_WORD}])(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+|(?:AKIA|ghp_|sk-|xox[abp]-)[A-Za-z0-9_-]{{10,}})(?![{_WORD}])",
    "iban": rf"(?<![{_WORD}])[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}"
    r"| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)"
    rf"(?![{_WORD}])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": rf"(?<![{_WORD}])(?:{_TITLES})\.?+(?: {_NAME_WORD})++",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Also capitalised words, in texts that name somebody: they may be the name again.
_ANY_OR_WORD = rf"{_ANY}|(?<![{_WORD}\p{{M}}]){_NAME_WORD}"
_DIGIT_KINDS = ("phone", "ssn", "card")

# The letters that names and addresses are made of.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ONSETS = {
    "latin": "b d f g h k l m n p r s t v w z".split(),
    "cyrillic": "б в г д з к л м н п р с т ф х ж".split(),
    "greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ξ".split(),
}
_VOWELS = {"latin": "aeio", "cyrillic": "аеио", "greek": "αειο"}
_ENDINGS = {
    "latin": {"given_m": "n", "given_f": "a", "given": "y", "family": "r"},
    "cyrillic": {"given_m": "н", "given_f": "а", "given": "я", "family": "в"},
    "greek": {"given_m": "ς", "given_f": "α", "given": "ι", "family": "ν"},
}


def _kind(entity: Column) -> Column:
    kind = F.when(entity.rlike(rf"^(?:{_TITLES})\.? \p{{Lu}}"), F.lit("name")).otherwise("word")
    for name, pattern in reversed(list(PATTERNS.items())):
        if name != "name":
            # Looks around a whole entity find nothing to object to.
            kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _number(hash_: Column, at: Column | int) -> Column:
    """0 to 255 from two hex digits of a hash, the ``at``-th pair, round and round."""
    place = (F.lit(at) if isinstance(at, int) else at) % 32 * 2 + 1
    return F.conv(F.substr(hash_, place, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), number % len(letters) + 1, F.lit(1))


def _digits(hash_: Column, count: Column) -> Column:
    digits = F.translate(hash_, "abcdef", "012345")
    return F.rpad(digits, count, digits)


def _like(text: Column, hash_: Column) -> Column:
    """``text`` with other letters and digits; signs stay."""
    changed = F.transform(
        F.split(text, ""),
        lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", _number(hash_, i)))
        .when(c.rlike(r"\p{Lu}"), _pick(_UPPER, _number(hash_, i)))
        .when(c.rlike(r"\p{L}"), _pick(_LOWER, _number(hash_, i)))
        .otherwise(c),
    )
    return F.array_join(changed, "")


def _luhn(digits: Column) -> Column:
    """Sum of the card check over digits whose last is the check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(place: Column) -> Column:
        digit = F.substr(digits, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when((F.length(digits) - place) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b)


def _card(canon: Column, hash_: Column) -> Column:
    """The first digit stays; the check holds if it held before."""
    head = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _digits(hash_, F.length(canon) - 2))
    check = ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")
    wrong = ((check.cast("int") + 1 + _number(hash_, 31) % 9) % 10).cast("string")
    return F.concat(head, F.when(_luhn(canon) % 10 == 0, check).otherwise(wrong))


def _phone(canon: Column, hash_: Column) -> Column:
    """``canon`` is country code, ``:`` and the other digits; the code stays."""
    code, rest = F.substring_index(canon, ":", 1), F.substring_index(canon, ":", -1)
    return F.concat(code, F.lit(":"), _digits(hash_, F.length(rest)))


def _ip(hash_: Column, more: Column) -> Column:
    """An address of the block that is reserved and never routed, or one of more numbers."""
    first = _number(hash_, 0) % 15 + 240
    address = F.concat_ws(".", *[n.cast("string") for n in (first, *[_number(hash_, k) for k in (1, 2, 3)])])
    return F.when(more > 0, F.concat(address, F.lit("."), _digits(hash_, more))).otherwise(address)


def _letters(hash_: Column, count: Column) -> Column:
    letters = F.translate(F.reverse(hash_), "0123456789", _LOWER[6:16])
    return F.rpad(F.lit(""), count, letters)


def _email(canon: Column, hash_: Column, extra: Column) -> Column:
    more = _letters(hash_, extra)
    domain = F.substring_index(canon, ".", -1)
    body = F.substr(canon, F.lit(1), F.length(canon) - F.length(domain) - 1)
    return F.concat(more, _like(body, hash_), F.lit("."), domain)


def _script(word: Column) -> Column:
    return (
        F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(word.rlike(r"\p{IsGreek}"), F.lit("greek"))
        .otherwise(F.lit("latin"))
    )


def _name(kind: Column, canon: Column, hash_: Column, more: Column) -> Column:
    """Open syllables and the ending of the script and gender."""
    found = F.lit(None).cast("string")
    for script, onsets in _ONSETS.items():
        syllable = lambda k, onsets=onsets, script=script: F.concat(
            F.element_at(F.array(*map(F.lit, onsets)), _number(hash_, 2 * k) % len(onsets) + 1),
            _pick(_VOWELS[script], _number(hash_, 2 * k + 1)),
        )
        ending = F.lit("")
        for role, letter in _ENDINGS[script].items():
            ending = F.when(kind == role, F.lit(letter)).otherwise(ending)
        longer = F.array_join(F.transform(F.sequence(F.lit(4), more + 4), lambda k: syllable(k)), "")
        name = F.concat(*[syllable(k) for k in range(4)], F.when(more > 0, longer).otherwise(""), ending)
        found = F.when(_script(canon) == script, name).otherwise(found)
    return found


def surrogate(kind: Column, canon: Column, hash_: Column, more: Column) -> Column:
    """The canonical form of the surrogate of an entity of that kind, ``more`` characters longer."""
    longer = F.when(more > 0, _digits(F.reverse(hash_), more)).otherwise("")
    return (
        F.when(kind == "email", _email(canon, hash_, more))
        .when(kind == "ip", _ip(hash_, more))
        .when(kind == "secret", F.concat(_secret(canon, hash_), longer))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), _like(F.substr(canon, F.lit(3)), hash_), longer))
        .when(kind == "phone", F.concat(_phone(canon, hash_), longer))
        .when(kind == "ssn", F.concat(_digits(hash_, F.lit(9)), longer))
        .when(kind == "card", F.concat(_card(canon, hash_), longer))
        .otherwise(_name(kind, canon, hash_, more))
    )


def _draw(units: DataFrame, key: str) -> DataFrame:
    """``units`` with ``new``, the surrogate of the unit's attempt."""
    told = F.concat_ws("\x01", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    hashed = stored(units.withColumn("hash", F.sha2(told, 256)), "hashed")
    more = F.greatest(F.col("attempt") - WIDER + 1, F.lit(0)) * MORE
    drawn = stored(hashed.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("hash"), more)).drop("hash"), "drawn")
    free(hashed)
    return drawn


def _secret(canon: Column, hash_: Column) -> Column:
    length = F.length(canon)
    prefix = F.regexp_extract(canon, "^(AKIA|ghp_|sk-|xox[abp]-)", 1)
    like = F.concat(prefix, _like(F.substr(canon, F.length(prefix) + 1), hash_))
    return (
        F.when(canon.rlike("^[0-9a-f]+$"), F.rpad(hash_, length, hash_))
        .when(canon.rlike("^[0-9A-F]+$"), F.upper(F.rpad(hash_, length, hash_)))
        .otherwise(like)
    )


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _canon(kind: Column, entity: Column) -> Column:
    code = F.regexp_extract(entity, r"^\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{7})", 1)
    phone = F.concat(code, F.lit(":"), F.substr(_only_digits(entity), F.length(code) + 1))
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "phone", phone)
        .when(kind.isin("ssn", "card"), _only_digits(entity))
        .when(kind == "iban", F.translate(entity, " ", ""))
        .when(kind == "word", F.lower(entity))
        .otherwise(entity)
    )


def _title(entity: Column) -> Column:
    return F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", "")


def _roles(entity: Column) -> Column:
    """(kind, canon) of a name's words: given names of the title's gender, then the family name."""
    title = _title(entity)
    sort = F.when(title.isin(MALE), "given_m").when(title.isin(FEMALE), "given_f").otherwise("given")
    # Bound once, not for each word.
    bound = F.array(F.struct(sort.alias("given"), F.split(entity, " ").alias("words")))

    def units(of: Column) -> Column:
        words = of["words"]
        given = F.transform(
            F.slice(words, 2, F.size(words) - 2), lambda w: F.struct(of["given"].alias("kind"), F.lower(w).alias("canon"))
        )
        family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
        return F.concat(given, F.array(family))

    return F.transform(bound, units)[0]


_ENTITY = "array<struct<text:string,kind:string,units:array<struct<kind:string,canon:string>>>>"


def _entities(text: Column, pattern: str = _ANY) -> Column:
    """A text's entities in order: ``text``, ``kind``, and what is replaced as one in
    ``units``: the words of a name, else the whole."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    kinds = F.transform(found, lambda e: F.struct(e.alias("text"), _kind(e).alias("kind")))

    def units(e: Column) -> Column:
        whole = F.array(F.struct(e["kind"].alias("kind"), _canon(e["kind"], e["text"]).alias("canon")))
        return F.struct(
            e["text"].alias("text"),
            e["kind"].alias("kind"),
            F.when(e["kind"] == "name", _roles(e["text"])).otherwise(whole).alias("units"),
        )

    return F.coalesce(F.transform(kinds, units), F.array()).cast(_ENTITY)


def _cased(new: Column, old: Column) -> Column:
    """``new`` in capitals, or with a first capital, or its initial, as ``old`` is."""
    return (
        F.when(old.rlike(r"^\p{Lu}\.$"), F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.lit(".")))
        .when((F.length(old) > 1) & (old == F.upper(old)) & (old != F.lower(old)), F.upper(new))
        .when(F.substr(old, F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), F.initcap(new))
        .otherwise(new)
    )


def _in_places(entity: Column, new: Column, sign: str) -> Column:
    """The entity with its characters that match ``sign`` exchanged one by one; what ``new`` has
    more comes last."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(done: Column, c: Column) -> Column:
        is_sign = c.rlike(sign)
        put = F.when(is_sign, F.substr(new, done["used"] + 1, F.lit(1))).otherwise(c)
        return F.struct(
            F.concat(done["text"], put).alias("text"),
            (done["used"] + is_sign.cast("int")).alias("used"),
        )

    end = lambda done: F.concat(done["text"], F.substr(new, done["used"] + 1, F.length(new)))
    return F.aggregate(F.split(entity, ""), start, step, end)


def _rendered(entity: Column, news: Column) -> Column:
    """The surrogate in the spelling of the entity; ``news`` are those of its units, NULL for
    a word that is no name."""
    text, kind, whole = entity["text"], entity["kind"], news[0]
    words = F.split(text, " ")
    cased = F.zip_with(news, F.slice(words, 2, F.size(words)), _cased)
    return (
        F.when(kind == "name", F.concat_ws(" ", words[0], F.array_join(cased, " ")))
        .when(kind == "word", F.coalesce(_cased(whole, text), text))
        .when(kind.isin(*_DIGIT_KINDS), _in_places(text, _only_digits(whole), "[0-9]"))
        .when(kind == "iban", _in_places(text, whole, "[^ ]"))
        .when((kind == "email") & (text == F.upper(text)), F.upper(whole))
        .otherwise(whole)
    )


def draw_surrogates(units: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``canon``, ``new``: a surrogate for each of the distinct units.

    A surrogate fails if it is a unit of the texts or also the surrogate of a unit that
    comes first: one of a smaller attempt, then of a smaller canonical form. Units whose
    surrogate fails draw again; from attempt ``WIDER`` on surrogates grow longer, so that
    there is one for each in the end.
    """
    drawn = _draw(units.select("kind", "canon", F.lit(0).alias("attempt")), key)
    real = units.select(F.col("kind").alias("real_kind"), F.col("canon").alias("real"))
    while True:
        sharing = drawn.groupBy(F.col("kind").alias("k"), F.col("new").alias("n")).agg(
            F.count("*").alias("sharing"), F.min(F.struct("attempt", "canon")).alias("keeper")
        )
        is_real = (F.col("k") == F.col("real_kind")) & (F.col("n") == F.col("real"))
        taken = sharing.join(real, is_real, "left").filter((F.col("sharing") > 1) | F.col("real").isNotNull())
        taken = stored(
            taken.select("k", "n", F.when(F.col("real").isNull(), F.col("keeper.canon")).alias("may_stay")), "taken"
        )
        if taken.isEmpty():
            free(taken)
            return drawn.select("kind", "canon", "new")
        met = drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("n")), "left")
        fails = F.col("k").isNotNull() & ~F.col("canon").eqNullSafe(F.col("may_stay"))
        again = met.select("kind", "canon", (F.col("attempt") + fails.cast("int")).alias("attempt"))
        before, drawn = drawn, _draw(again, key)
        free(before, taken)


_GIVEN = ("given_m", "given_f", "given")


def _told(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """What titles tell of a name's word within ``by``, as the struct ``name``."""
    of = lambda *kinds: F.max(F.col("unit.kind").isin(*kinds))
    told = F.struct(
        of("given_m").alias("m"), of("given_f").alias("f"), of(*_GIVEN).alias("given"), of("family").alias("family")
    )
    return rows.groupBy(*by).agg(told.alias(name))


def _one_gender(told: Column) -> Column:
    """The given name's kind, if titles agree on its gender."""
    male, female = told["m"] & ~told["f"], told["f"] & ~told["m"]
    return F.when(male, F.lit("given_m")).when(female, F.lit("given_f"))


def _resolved(mentions: DataFrame) -> DataFrame:
    """``mentions`` with the kinds of names settled; a word that is no name has a NULL unit.

    A word is a name if the text has it behind a title. A given name whose gender its own
    title does not tell has that of the same name elsewhere in the text, else in all texts,
    if there is but one.
    """
    canon = F.col("unit.canon")
    named = mentions.filter(F.col("unit.kind").isin(*_GIVEN, "family", "word"))
    titled = named.filter(F.col("unit.kind") != "word").select("number", canon.alias("c"), "unit")
    whole = _told(titled, ["c"], "whole").withColumnRenamed("c", "w")
    here = _told(titled, ["number", "c"], "here").withColumnRenamed("number", "n")
    here = here.join(whole, F.col("c") == F.col("w"))
    met = named.join(here, (F.col("number") == F.col("n")) & (canon == F.col("c")), "left")
    gender = F.coalesce(_one_gender(F.col("here")), _one_gender(F.col("whole")), F.lit("given"))
    kind = F.col("unit.kind")
    kind = (
        F.when(kind == "given", gender)
        .when(kind != "word", kind)
        .when(F.col("here.family"), F.lit("family"))
        .when(F.col("here.given"), gender)
    )
    unit = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), canon.alias("canon"))).alias("unit")
    rest = mentions.filter(~F.col("unit.kind").isin(*_GIVEN, "family", "word"))
    return rest.union(met.select("number", "place", "entity", unit))


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and the column ``entity_kinds`` of what was replaced.

    ``entity_kinds`` has one entry per entity in order of the text. NULL texts stay NULL,
    without entities; texts without entities stay as they are. Repeated rows stay. A
    column of ``docs`` named ``entity_kinds`` gives way to the result; columns of other
    names are handed on, whatever they are.
    """
    others = [c for c in docs.columns if c not in (text, "entity_kinds")]
    whole = F.col(text).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.struct(*others).alias("kept") if others else F.lit(0).alias("kept"),
        whole.alias("text"),
        _entities(whole).alias("entities"),
    )
    rows = stored(rows, "entities")
    found = rows.filter(F.size("entities") > 0)
    names = F.exists("entities", lambda e: e["kind"] == "name")
    found = found.withColumn("entities", F.when(names, _entities(F.col("text"), _ANY_OR_WORD)).otherwise(F.col("entities")))
    found = stored(found.withColumn("has_name", names), "found")
    # Place of a unit among all of the text, and of its entity, if it is that entity's first.
    one = F.transform(
        "entities",
        lambda e, i: F.transform(e["units"], lambda u, j: F.struct(F.when(j == 0, i).alias("entity"), u.alias("unit"))),
    )
    mentions = found.select("number", F.posexplode(F.flatten(one)).alias("place", "one"))
    mentions = mentions.select("number", "place", "one.entity", "one.unit")
    mentions = stored(_resolved(mentions), "mentions")
    units = stored(mentions.filter("unit IS NOT NULL").select("unit.*").distinct(), "units")
    drawn = draw_surrogates(units, key).select(F.struct("kind", "canon").alias("known"), "new")
    # Words that are no names are most of those without a unit; they spread by text.
    known = mentions.filter("unit IS NOT NULL").join(drawn, F.col("unit") == F.col("known"))
    placed = known.select("number", "place", "entity", "new").union(
        mentions.filter("unit IS NULL").select("number", "place", "entity", F.lit(None).cast("string"))
    )
    in_order = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    news = placed.groupBy(F.col("number").alias("of")).agg(
        in_order("place", "new")["new"].alias("news"),
        F.sort_array(F.collect_list(F.when(F.col("entity").isNotNull(), F.struct("entity", "place"))))["place"].alias("firsts"),
    )
    parts = F.when(F.col("has_name"), F.split("text", _ANY_OR_WORD, -1)).otherwise(F.split("text", _ANY, -1))
    spelled = F.transform(
        "entities",
        lambda e, i: _rendered(e, F.slice(F.col("news"), F.get("firsts", i) + 1, F.size(e["units"]))),
    )
    changed = F.array_join(F.zip_with(parts, spelled, lambda part, e: F.concat(part, F.coalesce(e, F.lit("")))), "")
    was_new = F.zip_with("entities", "firsts", lambda e, at: F.when(F.get("news", at).isNotNull(), e["kind"]))
    kinds = F.transform(F.filter(was_new, lambda k: k.isNotNull()), lambda k: F.when(k == "word", "name").otherwise(k))
    replaced = found.join(news, F.col("number") == F.col("of")).select("kept", changed.alias("text"), kinds.alias("entity_kinds"))
    none = F.array().cast("array<string>").alias("entity_kinds")
    same = rows.filter(F.size("entities") == 0).select("kept", "text", none)
    back = {c: F.col("kept")[c].alias(c) for c in others} | {text: F.col("text").alias(text)}
    return replaced.union(same).select(*[back[c] for c in docs.columns if c in back], "entity_kinds")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs).select(
        "doc_id", "text", F.size("entity_kinds").cast("bigint").alias("n_entities"), "entity_kinds"
    )
