"""Pseudonyms for personal data that keep its format: keyed Feistel permutations, in SQL expressions alone.

A value found in a text is permuted inside the set of all values of its format, under a key. Equal values get
equal pseudonyms in every document, different values different ones, and who has the key can go back. Nothing
is stored and nothing is shuffled: the pseudonym is a function of the value and the key.

Number kinds are validated and map onto valid values (mixed-radix Feistel: left in Z_a, right in Z_b, each
half moved by a keyed function of the other, which permutes Z_a x Z_b for any a and b):

* card: 13 to 19 digits that pass the Luhn check; all digits but the last are permuted and the check digit is set anew;
  in a run of digit groups each such number that is whole groups (those in a usual layout first, then the longest)
* phone: numbers of the North American plan, with +1 or without; area, exchange and line stay in their ranges; numbers
  with an area or exchange under 200, looked for behind +1 alone, move among themselves
* abroad: + and 8 to 15 digits, in groups or not; the first two stay (digits that follow by one space are taken as its part)
* ipv4: four octets of 0 to 255
* ipv6: eight groups, or up to seven with :: behind the second or a later one; pseudonyms are in lower case, and so go back
* ssn: area, group and serial in the ranges that are issued
* date: ISO dates that exist, of the years 1800 to 2199 (146097 = 189 x 773 days, so no cycle walking)

Text kinds (a Feistel network on strings: letters move among letters, digits among digits):

* email: the local part, without regard to case (it keeps its own)
* secret: access keys that begin with AKIA, sk- or ghp_, and what follows password= or token =, in whatever case

Defined cases: a null or empty text stays empty; what looks like a value but is not valid stays as it is;
repeated rows get equal results; texts of any length are one row's work; columns other than id and text are not used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm._spark import load, text_of, unused

#: The setting that has the key of a session's pseudonyms. Who has the key can undo them, so it belongs in no source.
KEY_SETTING = "spark.corpus.pii.key"
#: For tests and for the registered query over made-up data, where no key is set.
TEST_KEY = "corpus-pseudonyms-1"
ROUNDS = 8
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:sk-|ghp_)[A-Za-z0-9]{20,})|(?i:password)=(?![A-Za-z0-9._%+\-]{1,64}@)[A-Za-z0-9]{8,}|(?i:token) = \"[A-Za-z0-9]{16,}(?=\")",
    "phone": r"(?<![\d+])\+1 ?\(?\d{3}\)?[ \-]\d{3}-\d{4}(?!\d)|(?<![\d+(])(?<!\d[.\-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[.\-]\d{4}(?![\d]|[.\-]\d)",
    "date": r"(?<![\d\-])(?:18|19|20|21)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[\dA-Fa-f]{1,4}:){7}[\dA-Fa-f]{1,4}|(?:[\dA-Fa-f]{1,4}:){2,6}(?::[\dA-Fa-f]{1,4}){1,5})(?![\w:])",
}
#: What precedes the part of a secret that is permuted.
MARK = r"^(?:AKIA|sk-|ghp_|(?i:password)=|(?i:token) = \")"
#: Between two groups of digits of a run: a date, an SSN, a phone or an IP address isn't part of it.
GAP = rf"[ \-](?!{FORMS['date']}|{FORMS['ssn']}|{FORMS['ipv4']}|{FORMS['phone']})"
FORMS["abroad"] = rf"(?<![\w+])\+[2-9]\d(?:(?:{GAP})?\(?\d\)?){{6,13}}(?!\d)"
# a whole run of groups, of 13 digits or more, but no lone group of more than 19
FORMS["card"] = rf"(?<![\d\-])(?=\d(?:(?:{GAP})?\d){{12}})(?!\d{{20,}}+(?!{GAP}\d))\d++(?:{GAP}\d++)*+"
#: Usual layouts of card numbers.
LAYOUTS = r"^(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}(?: \d{3})?|\d{4} \d{6} \d{4,5})$"
ANY = "|".join(FORMS.values())


class Back(str):
    """A key that undoes what the same text does as a key."""


def key_of(spark: SparkSession) -> str:
    """The session's key, or the one for tests."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def _prf(key: str, *parts: Column | str) -> Column:
    """60 keyed bits as a long."""
    text = F.concat_ws("|", F.lit(str(key)), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. a*b-1, for any a and b."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))
    value = value.cast("long")
    start = F.struct(((value - F.pmod(value, b)) / b).cast("long").alias("l"), F.pmod(value, b).alias("r"), a.alias("a"), b.alias("b"))

    def back(s: Column, i: Column) -> Column:
        right = F.pmod(s["r"] - F.pmod(_prf(key, tweak, i.cast("string"), "r", s["l"].cast("string")), s["b"]), s["b"])
        return F.transform(
            F.array(right),
            lambda n: F.struct(F.pmod(s["l"] - F.pmod(_prf(key, tweak, i.cast("string"), "l", n.cast("string")), s["a"]), s["a"]).alias("l"), n.alias("r"), s["a"].alias("a"), s["b"].alias("b")),
        )[0]

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(_prf(key, tweak, i.cast("string"), "l", s["r"].cast("string")), s["a"]), s["a"])
        # the right half moves by the new left half
        return F.transform(
            F.array(left),
            lambda n: F.struct(n.alias("l"), F.pmod(s["r"] + F.pmod(_prf(key, tweak, i.cast("string"), "r", n.cast("string")), s["b"]), s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b")),
        )[0]

    rounds = F.sequence(F.lit(ROUNDS // 2), F.lit(1)) if isinstance(key, Back) else F.sequence(F.lit(1), F.lit(ROUNDS // 2))
    return F.aggregate(rounds, start, back if isinstance(key, Back) else turn, lambda s: s["l"] * s["b"] + s["r"])


def _shifted(text: Column, digest: Column, sign: int, hexadecimal: bool) -> Column:
    """Each letter and digit moved within its own kind (or all within 0 to f) by the bytes of a digest, or back."""

    def moved(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")
        if hexadecimal:
            return F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("int") + sign * by, F.lit(16))))
        to = lambda low, n: F.char(F.pmod(code - F.lit(low) + sign * by, F.lit(n)) + F.lit(low))
        return F.when(code.between(48, 57), to(48, 10)).when(code.between(65, 90), to(65, 26)).when(code.between(97, 122), to(97, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def feistel_text(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the strings with the same sequence of letters, digits and other characters.

    hexadecimal: of the strings of as many characters 0 to f instead.
    """
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def hashed(i: Column, side: str, other: Column) -> Column:
        return F.sha2(F.encode(F.concat_ws("|", F.lit(str(key)), F.lit(tweak), i.cast("string"), F.lit(side), other), "UTF-8"), 256)

    def moved(part: Column, digest: Column, sign: int) -> Column:
        return F.when(part == "", "").otherwise(_shifted(part, digest, sign, hexadecimal))

    def turn(s: Column, i: Column) -> Column:
        return _let(moved(s["l"], hashed(i, "l", s["r"]), 1), lambda n: F.struct(n.alias("l"), moved(s["r"], hashed(i, "r", n), 1).alias("r")))

    def back(s: Column, i: Column) -> Column:
        return _let(moved(s["r"], hashed(i, "r", s["l"]), -1), lambda n: F.struct(moved(s["l"], hashed(i, "l", n), -1).alias("l"), n.alias("r")))

    rounds = F.sequence(F.lit(ROUNDS // 2), F.lit(1)) if isinstance(key, Back) else F.sequence(F.lit(1), F.lit(ROUNDS // 2))
    return F.aggregate(rounds, start, back if isinstance(key, Back) else turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column, digit: str = r"\d") -> Column:
    return F.regexp_replace(text, f"[^{digit}]", "")


def _filled(layout: Column, digits: Column, digit: str = r"\d") -> Column:
    """The layout with its digits replaced, in order, by the given ones."""
    chars = F.split(layout, "")
    nth = lambda i: F.length(_digits(F.substr(layout, F.lit(1), i + 1), digit))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{digit}]"), F.substr(digits, nth(i), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is not doubled."""
    d = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(d, value), F.lit(0), lambda s, x: s + x)


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _card(m: Column, key: str) -> Column:
    """One number with its check digit set anew."""

    def done(d: Column) -> Column:
        n = F.length(d) - 1
        low = (n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        # the length is a tweak: numbers of different lengths never meet
        swapped = _let(_padded(feistel(F.substr(d, F.lit(1), n), ten(n - low), ten(low), key, "card"), n), lambda p: F.concat(p, F.pmod(-_luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        return _filled(m, swapped)

    return _let(_digits(m), done)


def _cards(m: Column, key: str) -> Column:
    """A run of digit groups with its valid card numbers replaced: text, and n, their number (1 if there is none)."""
    joined = lambda groups, i, size: F.array_join(F.slice(groups, i + 1, size), " ")

    def numbers(groups: Column, i: Column) -> Column:  # the valid numbers that begin at a group
        def judged(size: Column, t: Column) -> Column:
            good = F.when(F.length(_digits(t)).between(13, 19), F.pmod(_luhn_sum(_digits(t)), F.lit(10)) == 0).otherwise(F.lit(False))
            return F.struct(t.rlike(LAYOUTS).alias("usual"), size.alias("size"), good.alias("good"))

        sizes = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i))
        return F.filter(F.transform(sizes, lambda size: _let(joined(groups, i, size), lambda t: judged(size, t))), lambda c: c["good"])

    def scanned(groups: Column, valid: Column, usual: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            # no number takes a part of a later one in a usual layout, unless it has such a layout itself
            fits = F.filter(F.get(valid, i), lambda c: c["usual"] | ~F.exists(F.slice(usual, i + 2, c["size"] - 1), lambda u: u))
            return _let(F.coalesce(F.array_max(fits)["size"], F.lit(0)), lambda size: F.when(i < s["free"], s).otherwise(_let(F.greatest(size, F.lit(1)), lambda k: added(s, i, size, k))))

        def added(s: Column, i: Column, size: Column, k: Column) -> Column:
            at = F.length(s["text"])  # pseudonyms are as long as what they replace
            gap = F.when(i > 0, 1).otherwise(0)
            part = F.substr(m, at + gap + 1, F.length(joined(groups, i, k)))
            new = _let(part, lambda p: F.when(size > 0, _card(p, key)).otherwise(p))
            return F.struct((i + k).alias("free"), F.concat(s["text"], F.substr(m, at + 1, gap), new).alias("text"), (s["n"] + F.when(size > 0, 1).otherwise(0)).alias("n"))

        start = F.struct(F.lit(0).alias("free"), F.lit("").alias("text"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, turn, lambda s: F.struct(s["text"].alias("text"), F.greatest(s["n"], F.lit(1)).alias("n")))

    def run(groups: Column) -> Column:
        valid = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: numbers(groups, i))
        return _let(valid, lambda v: _let(F.transform(v, lambda c: F.exists(c, lambda x: x["usual"])), lambda usual: scanned(groups, v, usual)))

    return _let(F.split(m, r"[ \-]"), run)


def _phone(m: Column, key: str) -> Column:
    def done(d: Column) -> Column:  # 1, area, exchange, line
        area, exchange, line = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((2, 3), (5, 3), (8, 4)))
        value = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
        new = _let(feistel(value, 800, 8_000_000, key, "phone"), lambda v: F.concat(F.lit("1"), _padded(_over(v, 8_000_000) + 200, 3), _padded(F.pmod(_over(v, 10_000), F.lit(800)) + 200, 3), _padded(F.pmod(v, F.lit(10_000)), 4)))
        # 360,000 pairs outside the plan: 200 areas with any exchange, then 800 areas with 200 exchanges
        pair = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        spread = lambda p: F.when(p < 200_000, p).otherwise((_over(p - 200_000, 200) + 200) * 1000 + F.pmod(p - 200_000, F.lit(200)))
        other = _let(feistel(pair * 10_000 + line, 360_000, 10_000, key, "phone outside"), lambda v: F.concat(F.lit("1"), _padded(spread(_over(v, 10_000)), 6), _padded(F.pmod(v, F.lit(10_000)), 4)))
        return F.when((area >= 200) & (exchange >= 200), new).otherwise(other)

    # a number has one pseudonym, with +1 or without
    full = _digits(F.when(m.startswith("+"), m).otherwise(F.concat(F.lit("1"), m)))
    return _let(_let(full, done), lambda d: _filled(m, F.when(m.startswith("+"), d).otherwise(F.substr(d, F.lit(2)))))


def _abroad(m: Column, key: str) -> Column:
    return _let(_digits(m), lambda d: _let(F.concat(F.substr(d, F.lit(1), F.lit(2)), feistel_text(F.substr(d, F.lit(3)), key, "abroad")), lambda new: _filled(m, new)))


def _over(v: Column, n: int) -> Column:
    return ((v - F.pmod(v, F.lit(n))) / F.lit(n)).cast("long")


def _ipv4(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    return _let(feistel(value, 65536, 65536, key, "ipv4"), lambda v: F.concat_ws(".", *[F.pmod(_over(v, 256**k), F.lit(256)).cast("string") for k in (3, 2, 1)], F.pmod(v, F.lit(256)).cast("string")))


def _ipv6(m: Column, key: str) -> Column:
    digit = r"\dA-Fa-f"
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    new = _let(feistel_text(F.lower(_digits(m, digit)), key, "ipv6", hexadecimal=True), lambda d: _filled(m, d, digit))
    return F.when(m.contains("::") & (groups > 7), m).otherwise(new)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    dense = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas: 001-899 without 666
    value = (dense * 99 + group - 1) * 9999 + serial - 1
    spread = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
    new = _let(feistel(value, 898 * 99, 9999, key, "ssn"), lambda v: F.concat_ws("-", _padded(spread(_over(v, 99 * 9999)), 3), _padded(F.pmod(_over(v, 9999), F.lit(99)) + 1, 2), _padded(F.pmod(v, F.lit(9999)) + 1, 4)))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)


def _date(m: Column, key: str) -> Column:
    day = F.try_to_date(m, "yyyy-MM-dd")
    value = F.date_diff(day, F.lit("1800-01-01").cast("date"))
    new = F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), feistel(value, 189, 773, key, "date").cast("int")), "yyyy-MM-dd")
    return F.when(day.isNotNull(), new).otherwise(m)


def _email(m: Column, key: str) -> Column:
    parts = F.split(m, "@")
    # permuted without regard to case, and cased as it was: an address has one pseudonym however it is written
    cased = lambda new: F.array_join(F.zip_with(F.split(new, ""), F.split(parts[0], ""), lambda n, old: F.when(old.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")
    return F.concat(_let(feistel_text(F.lower(parts[0]), key, "email"), cased), F.lit("@"), parts[1])


def _secret(m: Column, key: str) -> Column:
    return _let(F.regexp_replace(m, MARK, ""), lambda body: F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(body)), feistel_text(body, key, "secret")))


def kind_of(m: Column) -> Column:
    """Which form a match has."""
    whole = lambda k: m.rlike(f"^(?:{FORMS[k]})$")
    tests = [("email", m.contains("@")), ("secret", m.rlike(MARK)), ("abroad", m.rlike(r"^\+[2-9]")), *[(k, whole(k)) for k in ("phone", "date", "ssn", "ipv4", "ipv6")]]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit("card"))


def _replaced(m: Column, key: str) -> Column:
    """The pseudonym of one match as text, and n, the number of values in it."""
    by = {"email": _email, "phone": _phone, "abroad": _abroad, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "ipv6": _ipv6}
    one = lambda text: F.struct(text.alias("text"), F.lit(1).alias("n"))
    return _let(kind_of(m), lambda k: F.when(k == "card", _cards(m, key)).otherwise(one(reduce(lambda rest, kind: F.when(k == kind, by[kind](m, key)).otherwise(rest), by, _secret(m, key)))))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match."""
    return _replaced(m, key)["text"]


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs as they were before pseudonymize() with the same key.

    Every kind goes back exactly. Only where several numbers stand in one run of digit groups may a pseudonym form a
    valid card number with a neighbour that its original didn't.
    """
    return pseudonymize(docs, Back(key), text_col)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with personal data in the text replaced; found_col gets the number of values found."""
    text = text_of(text_col)
    # every form has a digit, an @, the mark of a secret or the colons of an address: most texts are passed by with cheap scans
    hit = text.rlike("[0-9@]") | text.rlike("AKIA|sk-|ghp_|::|(?i:password)=|(?i:token) = |(?:[A-Fa-f]{1,4}:){7}")
    parts = F.when(hit, F.struct(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"), F.split(text, ANY, -1).alias("pieces")))

    def rebuilt(x: Column) -> Column:  # the pieces between the matches are one more than the matches
        new = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), x["found"], lambda p, m: _let(_replaced(m, key), lambda v: F.struct(F.concat(p, v["text"]).alias("text"), v["n"].alias("n"))))
        whole = lambda parts: F.concat(F.array_join(parts["text"], ""), F.element_at(x["pieces"], -1))
        done = lambda parts: F.struct(whole(parts).alias("text"), F.aggregate(parts["n"], F.lit(0), lambda s, n: s + n).cast("long").alias("n"))
        return F.when(F.size(x["found"]) > 0, _let(new, done)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))

    own = unused("llm_pii", tuple(docs.columns))
    done = docs.withColumn(own, F.when(hit, _let(parts, rebuilt)))
    columns = {text_col: F.coalesce(F.col(own)["text"], text)} | ({found_col: F.coalesce(F.col(own)["n"], F.lit(0).cast("long"))} if found_col else {})
    return done.select(*[F.col(f"`{c}`") if c not in columns else columns[c].alias(c) for c in docs.columns], *[v.alias(c) for c, v in columns.items() if c not in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, key_of(spark), found_col="n_found")
