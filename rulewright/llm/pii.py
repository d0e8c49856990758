"""PII: validated finds become format-preserving Feistel pseudonyms under a key.

Cards (Luhn), phone numbers, social-security numbers, IBANs (mod 97), IPv4 addresses, dates, e-mail addresses and
credentials are found in whole texts. The characters that carry a value are permuted by a Feistel network keyed by a secret
and the kind; separators, check digits, ranges and each letter's case are kept, by walking the cycle where a range is no power. The permutation depends on the
value alone, so equal values stay linked across documents, however they are spaced, and different ones stay apart. All of it is one projection of JVM expressions.
The key comes from the caller: whoever has it can undo the pseudonyms.

Card numbers start with 2 to 6, as those of all issuers do. Cards, IBANs and phone numbers with other country codes are tried from each start and at each admissible length, and only valid ones take part in the scan: the
leftmost first, then the longest. A phone number without +1 or brackets whose area code or exchange starts with 0 or 1 needs
dots or hyphens, as three numbers between spaces are mostly no phone number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import or_empty, read_table

#: Of the registered query alone, whose results must be the same everywhere. It protects nothing.
QUERY_KEY = "public key of op9_pii_pseudonyms"
ROUNDS, WALK, CHUNK, SLICE = 8, 48, 16, 64
DAY_ZERO, DAYS, SIDE = "1900-01-01", 73_049, 271

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
ACCESS_KEY = r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
_SECRET_HEAD = r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
SECRET = _SECRET_HEAD + r"(?=[A-Za-z_+/=-]*+[0-9])[0-9A-Za-z_+/=-]{12,}+"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
#: Four numbers after one of these words are a version, not an address.
VERSION = r"(?<!(?i:\b(?:version|release|build|ver|v)[ .:=]{0,2}))"
IPV4 = VERSION + r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9/.])[0-9]{2}([/.])[0-9]{2}\1[0-9]{4}(?![0-9/]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
WORLD_PHONE = r"(?<![0-9A-Za-z+])\+[2-9][0-9](?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "iban": IBAN, "ip": IPV4, "date": ISO_DATE, "day_date": DAY_DATE.replace(r"\1", "[/.]").replace("([/.])", "[/.]"), "ssn": SSN, "phone": PHONE, "world_phone": WORLD_PHONE, "card": CARD}
#: The kinds whose finds are listed for each text, as valid ones can't be told by a pattern.
LISTED = ("iban", "world_phone", "card")
CARD_LENGTHS, IBAN_LENGTHS, WORLD_LENGTHS = range(19, 12, -1), range(35, 11, -1), range(15, 7, -1)


def _draw(key: str, tweak: Column | str, i: Column, text: Column) -> Column:
    """48 bits."""
    seed = F.concat(F.lit(f"{key}|"), tweak if isinstance(tweak, Column) else F.lit(tweak), F.lit("|"), i.cast("string"), F.lit("|"), text)
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def feistel(s: Column, radix: int, tweak: Column | str, key: str) -> Column:
    """A keyed permutation of the strings of s's length over the first radix of 0-9a-z; at most 18 digits or 16 other characters."""
    number = lambda x: F.conv(x, radix, 10).cast("long")
    back = lambda x, n: F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), n, "0")
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        n = F.length(acc["a"])
        c = (number(acc["a"]) + _draw(key, tweak, i, acc["b"])) % F.pow(F.lit(float(radix)), n).cast("long")
        return F.struct(acc["b"].alias("a"), back(c, n).alias("b"))

    many = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))
    one = back((number(s) + _draw(key, tweak, F.lit(0), F.lit(""))) % radix, F.length(s))
    return F.when(F.length(s) == 0, s).when(F.length(s) == 1, one).otherwise(many)


def permute(s: Column, radix: int, kind: Column | str, key: str) -> Column:
    """Of any length, CHUNK characters at a time."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    chunks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / CHUNK).cast("int"))
    part = lambda k: feistel(F.substr(s, k * CHUNK + 1, F.lit(CHUNK)), radix, F.concat(kind, F.lit("|"), F.length(s).cast("string"), F.lit("|"), k.cast("string")), key)
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(chunks, part), ""))


def walk(s: Column, perm, ok) -> Column:
    """perm again and again until ok: a permutation of what is ok."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), perm(s), lambda x, _: F.when(ok(x), x).otherwise(perm(x)))


def put_back(form: Column, chars: Column, kind: str) -> Column:
    """form with its characters of the class kind replaced by chars in order."""
    place = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), f"[^{kind}]", ""))
    at = lambda i: F.when(F.substr(form, i, F.lit(1)).rlike(f"[{kind}]"), F.substr(chars, place(i), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))
    return F.when(F.length(form) == 0, form).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The Luhn sum of digits, modulo 10."""
    def step(acc: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return (acc + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10


def mod97(c: Column) -> Column:
    """Of letters and digits, a letter counting as 10 to 35."""
    def step(acc: Column, i: Column) -> Column:
        v = F.conv(F.substr(c, i, F.lit(1)), 36, 10).cast("int")
        return ((acc * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), step)


def let(x: Column, body) -> Column:
    """body(x) with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_AS_DIGITS = "0123456789abcdefghijklmnop"


def _letters(s: Column, kind: Column, key: str) -> Column:
    """Lower-case letters permuted."""
    return F.translate(permute(F.translate(s, _LETTERS, _AS_DIGITS), 26, kind, key), _AS_DIGITS, _LETTERS)


def _alnum(body: Column, kind: Column, key: str) -> Column:
    """Digits, lower-case and upper-case letters, each permuted among themselves under what the others are; all else stays.

    A permutation: the last class can be undone from the other two as they are now, then the second, then the first.
    """
    only = lambda c: F.regexp_replace(body, f"[^{c}]", "")
    under = lambda name, *x: F.concat_ws("|", kind, F.lit(name), *x)
    start = F.struct(only("0-9").alias("d"), only("a-z").alias("l"), F.lower(only("A-Z")).alias("u"))

    def upper(x: Column) -> Column:
        return F.struct(x["d"].alias("d"), x["l"].alias("l"), F.upper(_letters(x["u"], under("u", x["d"], x["l"]), key)).alias("u"))

    def lower(x: Column) -> Column:
        return let(F.struct(x["d"].alias("d"), _letters(x["l"], under("l", x["d"], x["u"]), key).alias("l"), x["u"].alias("u")), upper)

    def digit(x: Column) -> Column:
        return let(F.struct(permute(x["d"], 10, under("d", x["l"], x["u"]), key).alias("d"), x["l"].alias("l"), x["u"].alias("u")), lower)

    return let(let(start, digit), lambda x: put_back(put_back(put_back(body, x["d"], "0-9"), x["l"], "a-z"), x["u"], "A-Z"))


def _email(m: Column, key: str) -> Column:
    return F.concat(_alnum(F.substring_index(m, "@", 1), F.lit("email"), key), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    """Numbers, hexadecimal values of either case and all others are permuted apart, each walked until it is of its own sort and has a digit.

    In slices of SLICE characters, as put_back takes the square of a length.
    """
    body = F.regexp_extract(m, _SECRET_HEAD + "([0-9A-Za-z_+/=-]+)$", 1)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(body))
    mark = "_+/=-"
    number, low, high = (lambda x, c=c: x.rlike(f"^[{c}{mark}]+$") for c in ("0-9", "0-9a-f", "0-9A-F"))

    def slices(x: Column, one) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f".{{1,{SLICE}}}"), F.lit(0)), one), "")

    def hexes(up: bool):
        case = F.upper if up else F.lower
        return lambda x, i: put_back(x, case(permute(F.lower(F.regexp_replace(x, f"[{mark}]", "")), 16, F.concat(F.lit("hex|"), i.cast("string")), key)), "0-9A-Fa-f")

    plain = lambda x, i: _alnum(x, F.concat(F.lit("secret|"), i.cast("string")), key)
    mixed = lambda x: x.rlike("[0-9]") & ~number(x)
    new = F.when(number(body), slices(body, plain))
    new = new.when(low(body), walk(body, lambda x: slices(x, hexes(False)), mixed)).when(high(body), walk(body, lambda x: slices(x, hexes(True)), mixed))
    new = new.otherwise(walk(body, lambda x: slices(x, plain), lambda x: ~(low(x) | high(x))))
    return F.concat(head, new)


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substr(m, F.lit(1), F.lit(4)), F.upper(permute(F.lower(F.substr(m, F.lit(5), F.lit(16))), 36, "access_key", key)))


def _is_iban(m: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    return F.substr(flat, F.lit(3), F.lit(2)).between("02", "98") & (mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1)


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    bank = F.substr(flat, F.lit(5), F.length(flat))
    country = F.substr(flat, F.lit(1), F.lit(2))
    new = put_back(bank, permute(digits(bank), 10, "iban", key), "0-9")
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_is_iban(m), put_back(m, F.concat(country, check, new), "0-9A-Z"))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(parts, lambda x: x <= 255)
    packed = F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    new = permute(packed, 16, "ip", key)
    return F.when(valid, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(new, 2 * i + 1, F.lit(2)), 16, 10)), "."))


def _shift_date(day: Column, key: str, late: bool = False) -> Column:
    """A permutation of the days from 1900 to 2099, or of those after the twelfth of a month (late): two digits to the base SIDE, walked until in range."""
    turn = lambda n: F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.floor(n / SIDE).cast("long").alias("a"), (n % SIDE).cast("long").alias("b")),
        lambda acc, i: F.struct(acc["b"].alias("a"), ((acc["a"] + _draw(key, "date", i, acc["b"].cast("string"))) % SIDE).alias("b")),
        lambda acc: acc["a"] * SIDE + acc["b"],
    )
    start = F.datediff(day, F.lit(DAY_ZERO).cast("date")).cast("long")
    new = walk(start, turn, lambda n: (n < DAYS) & (F.dayofmonth(F.date_add(F.lit(DAY_ZERO).cast("date"), n.cast("int"))) > 12) if late else n < DAYS)
    return F.when((start >= 0) & (start < DAYS), F.date_add(F.lit(DAY_ZERO).cast("date"), new.cast("int")))


def _parsed(m: Column, form: str) -> Column:
    return F.try_to_timestamp(m, F.lit(form)).cast("date")


def _date(m: Column, key: str) -> Column:
    return F.date_format(_shift_date(_parsed(m, "yyyy-MM-dd"), key), "yyyy-MM-dd")


def _day_date(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit("."), F.lit("/"))
    day, month = _parsed(flat, "dd/MM/yyyy"), _parsed(flat, "MM/dd/yyyy")
    out = F.coalesce(F.date_format(_shift_date(day, key), "dd/MM/yyyy"), F.date_format(_shift_date(month, key, late=True), "MM/dd/yyyy"))
    return F.when(F.substr(m, F.lit(3), F.lit(1)) == F.substr(m, F.lit(6), F.lit(1)), F.when(F.contains(m, F.lit(".")), F.replace(out, F.lit("/"), F.lit("."))).otherwise(out))


def _ssn(m: Column, key: str) -> Column:
    ok = lambda d: ~d.rlike("^(?:000|666|9)|^...00|0000$")
    d = digits(m)
    return F.when(ok(d), put_back(m, walk(d, lambda x: feistel(x, 10, "ssn", key), ok), "0-9"))


def _phone(m: Column, key: str) -> Column:
    d = digits(m)
    own = F.substr(d, F.length(d) - 9, F.lit(10))
    usual = lambda x: x.rlike("^[2-9]..[2-9]")
    new = walk(own, lambda x: feistel(x, 10, "phone", key), lambda x: usual(x) == usual(own))
    return put_back(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new), "0-9")


def _world_phone(m: Column, key: str) -> Column:
    d = digits(m)
    return F.when(F.length(d).between(8, 15), put_back(m, F.concat(F.substr(d, F.lit(1), F.lit(2)), feistel(F.substr(d, F.lit(3), F.length(d)), 10, "phone", key)), "0-9"))


def _is_card(m: Column) -> Column:
    d = digits(m)
    return d.rlike("^[2-6]") & (luhn(d) == 0) & ~d.rlike("^(.)\\1+$")


def _card(m: Column, key: str) -> Column:
    d = digits(m)
    n = F.length(d)
    middle = feistel(F.substr(d, F.lit(2), n - 2), 10, "card", key)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), middle)
    check = ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    return F.when(_is_card(m), put_back(m, F.concat(body, check), "0-9"))


_HANDLERS = {"email": _email, "access_key": _access_key, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "day_date": _day_date, "ssn": _ssn, "phone": _phone, "world_phone": _world_phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """struct kind, out of one find: kind is null and out the find itself where it isn't valid."""
    kind, out = None, None
    for name, pattern in KINDS.items():
        inner = pattern.replace("(?<![0-9A-Za-z])", "").replace("(?<![0-9A-Za-z+])", "").replace(VERSION, "")
        is_it = m.rlike(f"^(?:{inner})$")
        label = F.lit(name.removeprefix("day_").removeprefix("world_"))
        kind = F.when(is_it, label) if kind is None else kind.when(is_it, label)
        out = F.when(is_it, _HANDLERS[name](m, key)) if out is None else out.when(is_it, _HANDLERS[name](m, key))
    return F.struct(kind.alias("kind"), out.alias("out"))


def _listed(text: Column, start: str, pattern: str, prefixes: list[str], valid) -> Column:
    """The valid finds of pattern's shape from each start in text at each length, the longest first."""
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{start}(?=({pattern.removeprefix(start)}))"), F.lit(1)))
    each = F.flatten(F.transform(longest, lambda m: F.array(*(F.regexp_extract(m, f"^({p})", 1) for p in prefixes))))
    found = F.filter(F.array_distinct(F.filter(each, lambda x: x != "")), valid)
    return F.array_sort(found, lambda a, b: F.length(b) - F.length(a))


def _scan(text: Column) -> Column:
    """The pattern of all finds of text; those of LISTED kinds stand in it one by one."""
    cards = [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9]" for n in CARD_LENGTHS]
    ibans = [rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + r")(?![0-9A-Za-z]" for n in IBAN_LENGTHS]
    phones = [rf"\+[0-9](?:[ .()-]{{0,3}}[0-9]){{{n - 1}}}\)?)(?![0-9]" for n in WORLD_LENGTHS]
    is_phone = lambda x: x.rlike(f"^(?:{WORLD_PHONE})$")
    edges = {"iban": ("(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"), "world_phone": ("(?<![0-9A-Za-z+])", "(?![0-9])"), "card": ("(?<![0-9])", "(?![0-9])")}
    how = {"iban": (ibans, _is_iban), "world_phone": (phones, is_phone), "card": (cards, _is_card)}
    lists = {k: _listed(text, edges[k][0], KINDS[k], *how[k]) for k in LISTED}
    parts = []
    for kind, pattern in KINDS.items():
        if kind in LISTED:
            one_of = F.concat(F.lit(f"{edges[kind][0]}(?:"), F.array_join(F.transform(lists[kind], lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|"), F.lit(f"){edges[kind][1]}"))
            parts.append(F.when(F.size(lists[kind]) > 0, one_of))
        else:
            parts.append(F.lit(f"(?:{pattern})"))
    return F.concat_ws("|", *parts)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs' columns with text pseudonymised, and n_pii and kinds (sorted, one of each).

    Null texts stay null and empty ones empty; a text without finds is returned unchanged. Rows are treated one
    by one, so repeated rows give equal results. Columns of docs named n_pii or kinds are replaced. An empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_pii", "kinds")]
    gate = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    docs = docs.select(*others, "text", F.when(gate, _scan(F.col("text"))).alias("__rw_scan"))
    found, gaps = F.regexp_extract_all(F.col("text"), F.col("__rw_scan"), F.lit(0)), F.split(F.col("text"), F.col("__rw_scan"))
    rows = docs.select(*others, "text", "__rw_scan", F.when(gate, found).otherwise(F.array().cast("array<string>")).alias("__rw_found"))
    rows = rows.withColumn("__rw_new", F.transform("__rw_found", lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))
    valid = F.filter("__rw_new", lambda x: x["p"]["out"].isNotNull())
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), F.col("__rw_new").alias("new")), lambda x: F.concat(x["gap"], F.coalesce(x["new"]["p"]["out"], x["new"]["m"], F.lit(""))))
    text = F.when(F.size("__rw_found") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["p"]["kind"]))), ",")
    return rows.select(*others, F.size(valid).cast("long").alias("n_pii"), kinds.alias("kinds"), text.alias("text"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
