"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Private values are found by one pattern, validated (Luhn for card numbers, modulo 97 for IBANs, calendar and octet ranges for
dates and addresses) and replaced by keyed Feistel permutations of their own format: a card number becomes another valid
card number of its length, a date another date between 1900 and 2099, an IPv4 address another, the digits of a telephone or
social security number other digits (of one that can be given out), letters and digits of a mail box or secret others of their class. The permutation depends
on the key and the value alone, so equal values stay linked across documents and different ones stay apart. What is not
valid (say, sixteen digits that fail Luhn) stays as it is; of a longer row of digit groups that is no card, the card in it is taken, as do all characters outside the values.

Scale: a map over rows; no shuffle, no Python. Texts without a digit, @ or key word skip the pattern. The pattern's parts are bounded (but for
secrets, which are never gone back into) and begin at the start of a run, so long runs don't cost their square.

Cases: a null text stays null with no values found; an empty one stays empty; repeated rows are treated alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: What stands before a secret, in any case.
KEY_WORDS = "token|secret|passwd|password|api_key|apikey|access_key"
#: Fixed shapes of the values, tried in this order at each place.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d(-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "secret": rf"(?<![A-Za-z0-9+/_-])(?<=(?i:{KEY_WORDS}) ?[=:] ?[\"']?)[A-Za-z0-9+/_-]{{16,}}+",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, and the two factors of the least product above whose halves are walked.
DAYS, DAY_A, DAY_B = 73_049, 271, 270


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digest(key: str, kind: str, number: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), value.cast("string")).cast("binary"), 256)


def byte_at(hexed: Column, i: Column) -> Column:
    return F.conv(F.substr(hexed, i * 4 - 3, F.lit(4)), 16, 10).cast("int")


def turned(c: Column, by: Column) -> Column:
    """The character moved by ``by`` inside its class; what is neither digit nor ASCII letter stays."""

    def cycle(first: str, n: int) -> Column:
        return F.char((F.ascii(c) - ord(first) + by) % n + ord(first))

    return F.when(c.between("0", "9"), cycle("0", 10)).when(c.between("a", "z"), cycle("a", 26)).when(c.between("A", "Z"), cycle("A", 26)).otherwise(c)


def permuted(key: str, kind: str, text: Column) -> Column:
    """Feistel over the characters: each round turns one half by a hash of the other, class by class. Halves beyond 16 characters use each hash place again."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))

    def one(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        new = let(digest(key, kind, r, b), lambda h: F.array_join(F.transform(F.split(a, ""), lambda c, i: F.when(c == "", c).otherwise(turned(c, byte_at(h, i % 16 + 1)))), ""))
        return F.struct(b.alias("a"), new.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda acc: F.concat(acc["a"], acc["b"]))


def permuted_pair(key: str, kind: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """Feistel over two numbers below ``size_a`` and ``size_b``, as a struct of both."""

    def one(acc: Column, r: Column) -> Column:
        moved = lambda x, other, n, k: (x + F.conv(F.substr(digest(key, kind, r * 2 + k, other), F.lit(1), F.lit(12)), 16, 10).cast("long") % n) % n
        return let(moved(acc["a"], acc["b"], size_a, 0), lambda x: F.struct(x.alias("a"), moved(acc["b"], x, size_b, 1).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), one)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of the digits, the last one not doubled."""
    value = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def mod97(text: Column) -> Column:
    """IBAN's remainder: the first four characters last, letters as 10 to 35."""
    turned_round = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned_round, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, new: Column, like: str = "[0-9]") -> Column:
    """``m`` with its characters that are ``like`` replaced in order by those of ``new``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def one(acc: Column, c: Column) -> Column:
        hit = c.rlike(like)
        return F.struct(F.concat(acc["o"], F.when(hit, F.substr(new, acc["k"], F.lit(1))).otherwise(c)).alias("o"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, one, lambda acc: acc["o"])


def date_of(m: Column) -> Column:
    """The date written as y-m-d, m/d/y (d/m/y where only that is one) or d.m.y; null if there is none from 1900 to 2099."""
    p = F.split(m, "[-/.]")
    at = lambda y, mo, d: F.try_to_date(F.concat_ws("-", p[y], F.lpad(p[mo], 2, "0"), F.lpad(p[d], 2, "0")))
    found = F.when(m.contains("-"), at(0, 1, 2)).when(m.contains("/"), F.coalesce(at(2, 0, 1), at(2, 1, 0))).otherwise(at(2, 1, 0))
    return F.when(F.year(found).between(1900, 2099), found)


def other_date(key: str, m: Column) -> Column:
    def step(n: Column) -> Column:
        return let(permuted_pair(key, "date", F.expr("0") + n % DAY_A, F.floor(n / DAY_A), DAY_A, DAY_B), lambda x: x["a"] + x["b"] * DAY_A)

    n = F.datediff(date_of(m), F.lit("1900-01-01").cast("date")).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(15)), step(n), lambda acc, i: F.when(acc < DAYS, acc).otherwise(step(acc)))
    p = F.split(m, "[-/.]")
    day_first = m.contains(".") | (m.contains("/") & F.try_to_date(F.concat_ws("-", p[2], F.lpad(p[0], 2, "0"), F.lpad(p[1], 2, "0"))).isNull())
    padded = F.when(m.contains("-"), F.lit(True)).otherwise((F.length(p[0]) == 2) & (F.length(p[1]) == 2))
    show = lambda d, long, short: F.when(padded, F.date_format(d, long)).otherwise(F.date_format(d, short))
    return let(F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int")), lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("."), show(d, "dd.MM.yyyy", "d.M.yyyy")).when(day_first, show(d, "dd/MM/yyyy", "d/M/yyyy")).otherwise(show(d, "MM/dd/yyyy", "M/d/yyyy")))


def other_ip(key: str, m: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = permuted_pair(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
    return let(pair, lambda x: F.concat_ws(".", *(F.expr("0") + v for v in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256))))


def other_card(key: str, m: Column) -> Column:
    def build(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return refilled(m, let(digits_of(m), build))


def other_iban(key: str, m: Column) -> Column:
    def build(v: Column) -> Column:
        body = permuted(key, "iban", F.substr(v, F.lit(5), F.length(v)))
        return let(body, lambda x: F.concat(F.substr(v, F.lit(1), F.lit(2)), F.lpad((98 - mod97(F.concat(F.substr(v, F.lit(1), F.lit(2)), F.lit("00"), x))).cast("string"), 2, "0"), x))

    return refilled(m, let(F.regexp_replace(m, " ", ""), build), "[A-Z0-9]")


def other_digits(key: str, kind: str, m: Column) -> Column:
    """All digits, or the last ten of a longer number (a country's code stays)."""
    return refilled(m, let(digits_of(m), lambda d: F.concat(F.substr(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(0))), permuted(key, kind, F.right(d, F.lit(10))))))


#: Social security numbers that are never given out.
NO_SSN = r"^(?:000|666|9..)|-00-|-0000$"


def other_ssn(key: str, m: Column) -> Column:
    """Another number that can be given out: the permutation goes on until it meets one."""
    step = lambda v: other_digits(key, "ssn", v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), step(m), lambda acc, i: F.when(acc.rlike(NO_SSN), step(acc)).otherwise(acc))


def whole(pattern: str) -> str:
    """The shape for a value that was cut out: what looks around it is gone."""
    import re

    return "^(?:" + re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\]|\((?:[^()\[\]]|\[[^\]]*\])*\))*\)", "", pattern) + ")$"


def kind_of(m: Column) -> Column:
    """Kind of a valid value; null leaves it alone."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(whole(SHAPES["iban"])) & (mod97(F.regexp_replace(m, " ", "")) == 1), "iban")
        .when(m.rlike(whole(SHAPES["ip"])), F.when(octets, "ip"))
        .when(m.rlike(whole(SHAPES["date"])), F.when(date_of(m).isNotNull(), "date"))
        .when(m.rlike(whole(SHAPES["ssn"])), F.when(~m.rlike(NO_SSN), "ssn"))
        .when(m.rlike(whole(SHAPES["phone"])), "phone")
        .when(m.rlike(whole(SHAPES["card"])), F.when(luhn_sum(digits_of(m)) % 10 == 0, "card"))
        .when(~m.rlike("[ .@]"), "secret")
    )


def pseudonym(key: str, m: Column, kind: Column) -> Column:
    box = F.substring_index(m, "@", 1)
    return (
        F.when(kind.isNull(), m)
        .when(kind == "email", F.concat(permuted(key, "email", box), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "iban", other_iban(key, m))
        .when(kind == "ip", other_ip(key, m))
        .when(kind == "date", other_date(key, m))
        .when(kind == "card", other_card(key, m))
        .when(kind == "secret", permuted(key, "secret", m))
        .when(kind == "ssn", other_ssn(key, m))
        .otherwise(other_digits(key, "phone", m))
    )


def card_in(m: Column) -> Column:
    """The valid card among the groups of a longer row of digits that is none: ``before``, ``card`` and ``after`` it; null if there is none.

    One unbroken or grouped by fours comes first, then the leftmost, then the longest."""

    def best(groups: Column) -> Column:
        n = F.size(groups)

        def one(s: Column, k: Column) -> Column:
            card = F.array_join(F.slice(groups, s, k), " ")
            before = F.when(s > 1, F.concat(F.array_join(F.slice(groups, 1, s - 1), " "), F.lit(" "))).otherwise("")
            usual = card.rlike(r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})$")
            return F.struct((~usual).alias("odd"), s.alias("s"), (-k).alias("k"), before.alias("before"), card.alias("card"))

        every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda k: one(s, k))))
        return F.array_min(F.filter(every, lambda x: F.length(digits_of(x["card"])).between(13, 19) & (luhn_sum(digits_of(x["card"])) % 10 == 0)))

    found = let(best(F.split(m, " ")), lambda x: F.when(x.isNotNull(), F.struct(x["before"].alias("before"), x["card"].alias("card"), F.substr(m, F.length(x["before"]) + F.length(x["card"]) + 1, F.length(m)).alias("after"))))
    return F.when(m.contains(" ") & m.rlike(whole(SHAPES["card"])) & kind_of(m).isNull(), found)


def pieces(parts: Column, old: Column) -> Column:
    """(hit, v): the text in order, as what matched and what did not."""
    piece = lambda hit, v: F.struct(F.lit(hit).alias("hit"), v.alias("v"))
    return F.filter(F.flatten(F.zip_with(parts, old, lambda p, m: F.array(piece(False, p), piece(True, m)))), lambda x: x["v"].isNotNull())


def pieces_around(parts: Column, old: Column, cuts: Column) -> Column:
    """As ``pieces``, with the cards of ``cuts`` taken out of their matches and what lay around them looked through anew."""
    gap = lambda p, i: F.concat(F.coalesce(F.get(cuts, i - 1)["after"], F.lit("")), p, F.coalesce(F.get(cuts, i)["before"], F.lit("")))
    again = lambda g: pieces(F.split(g, PATTERN, -1), F.regexp_extract_all(g, F.lit(PATTERN), F.lit(0)))
    own = lambda i: F.filter(F.array(F.struct(F.lit(True).alias("hit"), F.coalesce(F.get(cuts, i)["card"], F.get(old, i)).alias("v"))), lambda x: x["v"].isNotNull())
    return F.flatten(F.transform(parts, lambda p, i: F.concat(let(gap(p, i), lambda g: F.when(g == p, F.array(F.struct(F.lit(False).alias("hit"), p.alias("v")))).otherwise(again(g))), own(i))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the new text and ``found``: kind, old and new value of each private value, in order."""
    text = F.col(text_col)
    looked = F.when(text.rlike(f"[0-9@]|(?i:{KEY_WORDS})"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = docs.select(*keep, text.alias("__text"), looked.alias("__old"))
    rows = rows.withColumn("__cuts", F.when(F.size("__old") > 0, F.transform("__old", card_in)))
    parts, cuts = F.split("__text", PATTERN, -1), F.col("__cuts")
    rows = rows.withColumn("__pieces", F.when(F.size("__old") > 0, F.when(F.exists(cuts, lambda x: x.isNotNull()), pieces_around(parts, F.col("__old"), cuts)).otherwise(pieces(parts, F.col("__old")))))
    none = F.lit(None).cast("string")
    kinds = F.transform("__pieces", lambda x: F.when(x["hit"], let(kind_of(x["v"]), lambda k: F.struct(k.alias("kind"), x["v"].alias("old"), pseudonym(key, x["v"], k).alias("new")))).otherwise(F.struct(none.alias("kind"), x["v"].alias("old"), x["v"].alias("new"))))
    rows = rows.withColumn("__all", kinds)
    joined = F.array_join(F.transform("__all", lambda x: x["new"]), "")
    found = F.filter("__all", lambda x: x["kind"].isNotNull())
    return rows.select(*keep, F.when(F.size("__all") > 0, joined).otherwise(F.col("__text")).alias("text"), F.coalesce(found, F.array().cast("array<struct<kind:string,old:string,new:string>>")).alias("found"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_private and the kinds found: one row for each row of documents. The key is the session's ``spark.claimgrid.pseudonym.key``; the default is for tests."""
    out = pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.claimgrid.pseudonym.key", "claimgrid"))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_private"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",").alias("kinds"))
