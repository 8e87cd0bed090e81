"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass their format's check (card: Luhn digit; IBAN: remainder of 97; address: bytes up to 255; date: a day of
the calendar; social number: an area, group and serial that can be given out; telephone: 7 to 15 digits) and e-mail names are permuted
within their format by a keyed Feistel network, so that equal values stay equal everywhere and different ones stay different. What is
produced passes the same check. Values are equal however they are written: IBANs and cards with or without spaces, e-mail names in either
case, dates in any order. Dates with slashes are month first if that is a day of the calendar, else day first; a date keeps whether its
day is above 12, so that neither reading turns into the other. Cards and IBANs are looked for at each group of a run of groups, so that
numbers beside them don't hide them. Everything is built from DataFrame functions: a text is split at the matches, and the permuted
matches are put between the pieces; no shuffle is needed.

Defined results: null text stays null and counts 0. Empty text stays empty. Repeated rows are treated alike. Other columns pass
through unchanged, also one named like a helper here (the work happens inside two expressions). Whole texts are read,
however long; work grows with the text and the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import table

EDGE, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IBAN = EDGE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)" + END
ADDRESS = EDGE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + END
DATE = EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + END
PHONE = r"(?:\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|" + EDGE + r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + END
SOCIAL = EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END
CARD = EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})" + END
#: In the order in which they are tried at a place.
FORMATS = {"email": EMAIL, "iban": IBAN, "address": ADDRESS, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD}
#: Groups of digits or of an IBAN, up to where another format begins. A run may have values with other numbers on both sides.
_OTHER = "|".join(FORMATS[name] for name in ("email", "address", "date", "social", "phone"))
_GROUP = r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z0-9]{1,4}|[0-9]{5,19})" + END
RUN = EDGE + r"(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}|[0-9](?:[\x20-]?[0-9]){11})" + _GROUP + r"(?:[\x20-](?!" + _OTHER + ")" + _GROUP + ")*+"
ANY = "|".join([pattern for name, pattern in FORMATS.items() if name not in ("iban", "card")] + [RUN])
#: How many groups a spaced card and a spaced IBAN can have.
CARD_GROUPS, IBAN_GROUPS = (5, 4, 3, 1), (9, 8, 7, 6, 5, 4, 1)
ROUNDS = 8
#: Days of a cycle of 400 years, 146097 = 189 * 773, in which calendar days repeat.
DAY_HALVES, CYCLE = (189, 773), 146097
#: Social numbers: areas but 000, 666 and 9xx with groups but 00, and serials but 0000.
SOCIAL_HALVES = (898 * 99, 9999)
#: Characters that one digest moves.
CHUNK = 32


def _hash(key: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *what), 256)


def _permute_number(value: Column, left: int, right: int, key: str) -> Column:
    """Permutation of 0..left*right-1: the halves take turns in adding a keyed hash of the other one."""
    start = F.struct(F.expr("0L").alias("unused"), F.floor(value / right).cast("long").alias("a"), F.pmod(value, F.lit(right)).cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        noise = F.conv(F.substring(_hash(key, i, F.when(even, acc.b).otherwise(acc.a)), 1, 15), 16, 10).cast("long")
        a = F.when(even, F.pmod(acc.a + noise, F.lit(left))).otherwise(acc.a)
        b = F.when(even, acc.b).otherwise(F.pmod(acc.b + noise, F.lit(right)))
        return F.struct(acc.unused.alias("unused"), a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: x.a * right + x.b)


def _shifted(half: Column, seed: Column) -> Column:
    """half with digits, small and large letters each moved within their class by noise of seed, 64 hexadecimal digits for CHUNK characters."""

    def move(c: Column, i: Column, noise: Column) -> Column:
        n = F.conv(F.substr(noise, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda first, size: F.char(F.pmod(F.ascii(c) - ord(first) + n, F.lit(size)) + ord(first))
        return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)

    def chunk(own: Column, n: Column) -> Column:
        noise = F.when(n == 0, seed).otherwise(F.sha2(F.concat_ws("|", seed, n), 256))
        return _let(noise, lambda x: F.array_join(F.transform(F.split(own, ""), lambda c, i: move(c, i, x)), ""))

    return F.array_join(F.transform(F.regexp_extract_all(half, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), chunk), "")


def _permute_text(value: Column, key: str) -> Column:
    """Permutation of the texts with the same classes of characters (digit, small, large letter, other)."""
    middle = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1, F.length(value)).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, _let(_hash(key, i, acc.b), lambda h: _shifted(acc.a, h))).otherwise(acc.a)
        b = F.when(even, acc.b).otherwise(_let(_hash(key, i, acc.a), lambda h: _shifted(acc.b, h)))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x.a, x.b))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at odd (1) or even (0) places doubled."""
    each = lambda c, i: (lambda d: F.when(i % 2 == doubled, d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d))(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), each), F.lit(0), lambda a, x: a + x)


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _spread(values: Column, form: Column, fills=_is_digit) -> Column:
    """form with the characters that `fills` says replaced by those of values, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(F.concat(acc.out, F.when(fills(c), F.substr(values, acc.k, F.lit(1))).otherwise(c)).alias("out"), (acc.k + fills(c).cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda x: x.out)


def _card(m: Column, key: str) -> Column:
    body = lambda d: _let(_permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key), lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 0), F.lit(10)).cast("string")))
    return _let(_digits(m), lambda d: F.when(_luhn_sum(d, 1) % 10 == 0, _spread(body(d), m)).otherwise(m))


def _rest97(alnum: Column) -> Column:
    number = lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55)).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(alnum, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("A", "Z"), F.lit(100)).otherwise(F.lit(10)) + number(c), F.lit(97)))


def _bare(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def _iban(m: Column, key: str) -> Column:
    def new(bare: Column) -> Column:
        country = F.substr(bare, F.lit(1), F.lit(2))
        rest = lambda p: F.lpad((98 - _rest97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0")
        own = _let(_permute_text(F.substr(bare, F.lit(5), F.lit(64)), key), lambda p: F.concat(country, rest(p), p))
        valid = _rest97(F.concat(F.substr(bare, F.lit(5), F.lit(64)), F.substr(bare, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, _let(own, lambda x: _spread(x, m, lambda c: c != " "))).otherwise(m)

    return _let(_bare(m), new)


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(octets, F.expr("0L"), lambda a, x: a * 256 + x)
    shape = lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(octets, lambda x: x <= 255), _let(_permute_number(value, 65536, 65536, key), shape)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    first = F.unix_date(F.lit("1600-01-01").cast("date"))

    def moved(day: Column) -> Column:
        """Another day with its day of the month on the same side of 12: the permutation is applied until there is one."""
        place = F.pmod(day - first, F.lit(CYCLE)).cast("long")
        early = lambda at: F.dayofmonth(F.date_from_unix_date((at + first).cast("int"))) <= 12
        once = lambda at: _permute_number(at, *DAY_HALVES, key)
        new = F.aggregate(F.sequence(F.lit(0), F.lit(63)), once(place), lambda at, i: F.when(early(at) == early(place), at).otherwise(once(at)))
        return F.date_from_unix_date((new + F.floor((day - first) / CYCLE) * CYCLE + first).cast("int"))

    def shaped(form: str):
        return lambda d: F.when(d.isNotNull(), F.date_format(moved(d), form))

    iso, dotted = m.substr(5, 1) == "-", m.substr(3, 1) == "."
    forms = [(iso, "yyyy-MM-dd"), (~iso & dotted, "dd.MM.yyyy"), (~iso & ~dotted, "MM/dd/yyyy"), (~iso & ~dotted, "dd/MM/yyyy")]
    out = F.when(F.lit(False), m)
    for when, form in forms:
        year = m.substr(1, 4) if form[0] == "y" else m.substr(7, 4)
        day = F.when(when & (year >= "0400"), F.unix_date(F.try_to_timestamp(m, F.lit(form)).cast("date")))
        out = F.coalesce(out, _let(day, shaped(form)))
    return F.coalesce(out, m)


def _social(m: Column, key: str) -> Column:
    area, group, serial = (m.substr(at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    value = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

    def shape(v: Column) -> Column:
        place = F.floor(v / (9999 * 99)) + 1
        parts = ((place + (place >= 666).cast("long"), 3), (F.floor(v / 9999) % 99 + 1, 2), (v % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, _let(_permute_number(value, *SOCIAL_HALVES, key), shape)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """All digits but a country's code are permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)
    tail = F.substr(m, F.length(code) + 1, F.length(m))
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(code, _let(_permute_text(_digits(tail), key), lambda p: _spread(p, tail)))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """The name is permuted in lower case and gets its large letters back where they were."""
    name = F.substring_index(m, "@", 1)
    cased = lambda p: F.array_join(F.zip_with(F.split(name, ""), F.split(p, ""), lambda old, new: F.when(old.between("A", "Z"), F.upper(new)).otherwise(new)), "")
    return F.concat(_let(_permute_text(F.lower(name), key), cased), F.lit("@"), F.substring_index(m, "@", -1))


REPLACE = {"email": _email, "iban": _iban, "address": _address, "date": _date, "social": _social, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of a match of ANY; the match itself if it fails its format's check."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    out = F.when(F.contains(match, F.lit("@")), _email(match, key + "email"))
    for name, pattern in FORMATS.items():
        if name != "email":
            out = out.when(whole(pattern), REPLACE[name](match, key + name))
    return out.otherwise(match)


def _valid_iban(m: Column) -> Column:
    bare = _bare(m)
    return m.rlike(f"^(?:{IBAN})$") & F.length(bare).between(15, 34) & (_rest97(F.concat(F.substr(bare, F.lit(5), F.lit(64)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)


def _valid_card(m: Column) -> Column:
    return m.rlike(f"^(?:{CARD})$") & (_luhn_sum(_digits(m), 1) % 10 == 0)


def _values(gap: Column, run: Column) -> Column:
    """array<struct<gap, old>>: a run's cards and IBANs, from the left and each the longest that is valid; last, what follows them."""
    groups = F.regexp_extract_all(run, F.lit(r"[\x20-]?[A-Z0-9]+"), F.lit(0))

    def length(own: Column, group: Column, i: Column) -> Column:
        """How many groups the value that begins with group i has; 0 if none does."""
        some = lambda n: F.regexp_replace(F.array_join(F.slice(own, i + 1, F.lit(n)), ""), r"^[\x20-]", "")
        fits = lambda n: F.size(own) >= i + n
        iban = F.coalesce(*[F.when(fits(n) & _valid_iban(some(n)), F.lit(n)) for n in IBAN_GROUPS], F.lit(0))
        card = F.coalesce(*[F.when(fits(n) & _valid_card(some(n)), F.lit(n)) for n in CARD_GROUPS], F.lit(0))
        return F.when(group.rlike(r"^[\x20-]?[A-Z]{2}[0-9]{2}"), iban).when(group.rlike(r"^[\x20-]?(?:[0-9]{4}|[0-9]{13,19})$"), card).otherwise(F.lit(0))

    def parts(own: Column) -> Column:
        lengths = F.transform(own, lambda g, i: F.struct(i.alias("at"), length(own, g, i).alias("n")))
        start = F.struct(F.array().cast("array<struct<from:int,at:int,n:int>>").alias("found"), F.lit(0).alias("end"))

        def step(acc: Column, x: Column) -> Column:
            taken = (x.n > 0) & (x["at"] >= acc.end)
            more = F.concat(acc.found, F.array(F.struct(acc.end.alias("from"), x["at"].alias("at"), x.n.alias("n"))))
            return F.struct(F.when(taken, more).otherwise(acc.found).alias("found"), F.when(taken, x["at"] + x.n).otherwise(acc.end).alias("end"))

        # a shorter value that is valid by chance must not hide a longer one that begins in it
        first = lambda some: F.filter(some, lambda x: ~F.exists(some, lambda y: (y["at"] > x["at"]) & (y["at"] < x["at"] + x.n) & (y.n > x.n)))
        return _let(F.filter(lengths, lambda x: x.n > 0), lambda some: _let(F.aggregate(first(some), start, step), lambda r: _pieces(own, r)))

    def _pieces(own: Column, r: Column) -> Column:
        joined = lambda a, n: F.array_join(F.slice(own, a + 1, n), "")
        before = lambda x: F.when(x["from"] == 0, gap).otherwise(F.lit(""))

        def piece(x: Column) -> Column:
            return _let(joined(x["at"], x.n), lambda v: _let(F.regexp_extract(v, r"^[\x20-]?", 0), lambda sep: F.struct(F.concat(before(x), joined(x["from"], x["at"] - x["from"]), sep).alias("gap"), F.substr(v, F.length(sep) + 1, F.length(v)).alias("old"))))

        rest = F.struct(F.concat(F.when(r.end == 0, gap).otherwise(F.lit("")), joined(r.end, F.size(own) - r.end)).alias("gap"), F.lit(None).cast("string").alias("old"))
        return F.concat(F.transform(r.found, piece), F.array(rest))

    return _let(groups, parts)


def replaced(text: Column, key: str) -> Column:
    """array<struct<gap, old, new>>: the pieces of text between values, each with the value that follows it and its pseudonym."""
    zipped = F.arrays_zip(F.split(text, ANY, -1).alias("gap"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("old"))
    one = lambda x: F.array(F.struct(x.gap.alias("gap"), x.old.alias("old")))
    pieces = F.flatten(F.transform(zipped, lambda x: F.when(x.old.rlike(f"^(?:{RUN})$"), _values(x.gap, x.old)).otherwise(one(x))))
    return F.transform(pieces, lambda x: F.struct(x.gap.alias("gap"), x.old.alias("old"), pseudonym(x.old, key).alias("new")))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with pseudonyms in the column text; count names a column to add with the number of values that changed."""
    taken = next(n for i in range(len(docs.columns) + 1) if (n := f"_pieces{i}") not in docs.columns)
    column = F.col(f"`{text}`")
    pieces = docs.withColumn(taken, F.when(column.rlike("[0-9@]"), replaced(column, key)))
    out = pieces.withColumn(text, F.when(F.col(taken).isNull(), column).otherwise(F.array_join(F.transform(taken, lambda x: F.concat(x.gap, F.coalesce(x.new, F.lit("")))), "")))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.filter(taken, lambda x: x.old != x.new)), F.lit(0)).cast("long"))
    return out.drop(taken)


#: The key of the registered query; a job takes its own from its secret store.
DEMO_KEY = "op2-demonstration-key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, DEMO_KEY, count="n_replaced")
